"""Provider files as tables: frames, objects, events, rosters, shots and price histories.

Schemas are declared, never inferred.  Line files (bz2 too) split across tasks; ``_metadata.file_path`` names the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark.functions import geometry as G
from gridmark.functions import scalars
from gridmark.session import hinted

PLAYER = "struct<jerseyNum:string,confidence:string,visibility:string,x:double,y:double>"
FRAME = f"frameNum long, period long, periodElapsedTime double, videoTimeMs double, homePlayers array<{PLAYER}>, awayPlayers array<{PLAYER}>, balls array<struct<visibility:string,x:double,y:double,z:double>>, game_event struct<game_event_type:string,home_ball:boolean>"
PERSON = "array<struct<playerId:string,x:double,y:double>>"
EVENT = f"gameEventId long, startTime double, eventTime double, gameEvents struct<gameEventType:string,setpieceType:string,period:long,homeTeam:boolean,playerId:string,startGameClock:double>, possessionEvents struct<possessionEventType:string,shotOutcomeType:string,shooterPlayerId:string>, ball array<struct<x:double,y:double>>, homePlayers {PERSON}, awayPlayers {PERSON}"
ROSTER = "player struct<id:string,nickname:string>, team struct<id:string>, positionGroupType string, shirtNumber string, started boolean"
SHOT = "id string, period long, timestamp string, location array<double>, type struct<name:string>, team struct<id:long>, shot struct<type:struct<name:string>,outcome:struct<name:string>,statsbomb_xg:double>, pass struct<type:struct<name:string>>"
FREEZE = "event_uuid string, freeze_frame array<struct<teammate:boolean,keeper:boolean,location:array<double>>>"
# Codes of events that make the ball dead or alive.
DEAD_EVENTS, LIVE_EVENTS = ("OUT", "END"), ("OTB", "FIRSTKICKOFF", "SECONDKICKOFF")


def match_of(path: Column) -> Column:
    """The file's name without its endings."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)+$", 1)


def tracking_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line of JSON tracking files, with its match and its place in the file's order (by frameNum)."""
    return spark.read.schema(FRAME).json(path).select(match_of(F.col("_metadata.file_path")).alias("match_id"), "*")


def carried_state(lines: DataFrame) -> DataFrame:
    """``lines`` with ball_state and possession_team carried forward over all lines, dropped ones too; dead and unowned at first."""
    w = Window.partitionBy("match_id").orderBy("frameNum", "videoTimeMs").rowsBetween(Window.unboundedPreceding, 0)
    code = F.col("game_event.game_event_type")
    state = F.when(code.isin(*DEAD_EVENTS), "dead").when(code.isin(*LIVE_EVENTS), "alive")
    team = F.when(F.col("game_event.home_ball"), "home").when(~F.col("game_event.home_ball"), "away")
    return lines.withColumns({"ball_state": F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit("dead")), "possession_team": F.last(team, ignorenulls=True).over(w)})


def with_drop_reason(lines: DataFrame) -> DataFrame:
    """``drop_reason`` of a line: no period, or its frame number again; null for kept ones."""
    w = Window.partitionBy("match_id").orderBy("frameNum", "videoTimeMs")
    again = F.lag("frameNum").over(w) == F.col("frameNum")
    return lines.withColumn("drop_reason", F.when(F.col("period").isNull(), "no period").when(again, "repeated frame"))


def frames(kept: DataFrame) -> DataFrame:
    return kept.where("drop_reason IS NULL").select("match_id", F.col("frameNum").alias("frame_id"), "period", F.col("periodElapsedTime").alias("timestamp_s"), (F.col("period") % 2 == 1).alias("home_attacks_positive_x"), "ball_state", "possession_team", F.lit(None).cast("string").alias("ball_carrier_id"))


def objects(kept: DataFrame) -> DataFrame:
    """Exploded players and the first ball with a position; a second row of a jersey on a side and frame goes, as do rows without position."""
    base = kept.where("drop_reason IS NULL")
    people = []
    for side in ("home", "away"):
        p = base.select("match_id", F.col("frameNum").alias("frame_id"), F.posexplode(f"{side}Players").alias("pos", "p")).where("p.x IS NOT NULL AND p.y IS NOT NULL")
        people.append(p.select("match_id", "frame_id", "pos", F.concat_ws("_", F.lit(side), "p.jerseyNum").alias("object_id"), F.lit("player").alias("object_type"), F.lit(side).alias("team"), "p.x", "p.y", F.lit(None).cast("double").alias("z"), (F.col("p.visibility") == "VISIBLE").alias("visible"), scalars.named(F.col("p.confidence"), scalars.CONFIDENCE).alias("confidence")))
    rows = people[0].unionByName(people[1])
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("match_id", "frame_id", "object_id").orderBy("pos"))).where("n = 1").drop("n", "pos")
    ball = F.get(F.filter("balls", lambda b: b["x"].isNotNull()), F.lit(0))
    balls = base.select("match_id", F.col("frameNum").alias("frame_id"), ball.alias("b")).where("b IS NOT NULL").select("match_id", "frame_id", F.lit("ball").alias("object_id"), F.lit("ball").alias("object_type"), F.lit(None).cast("string").alias("team"), "b.x", "b.y", "b.z", (F.col("b.visibility") == "VISIBLE").alias("visible"), F.lit(1.0).alias("confidence"))
    out = rows.unionByName(balls)
    return out.withColumn("interpolated", ~F.col("visible"))


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, element): the objects of JSON array files as texts in file order, each file read by as many tasks as it has blocks.

    Lines end at ``}``, so a block is read without knowing what comes before it.  Whether a piece begins inside a string, how deep it lies and which object it belongs to are
    running sums: each block sums up its own, the blocks of a file are added up in order (a row for each block), and pieces take their block's start from there.
    An object that crosses blocks is put together by its number.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value"))
    here = Window.partitionBy("file", "block").orderBy("at")
    up_to, blocks = here.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bare = F.regexp_replace("value", r"\\.", "")
    outside = lambda text: F.regexp_replace(text, '"[^"]*("|$)', "")
    rows = raw.withColumns({"bare": bare, "quotes": F.regexp_count(bare, F.lit('"'))}).withColumn("before", F.coalesce(F.sum("quotes").over(up_to), F.lit(0)))

    def from_start(rows: DataFrame, total: str, into: str) -> DataFrame:
        """``rows`` with the sum of ``total`` over their file's earlier blocks."""
        sums = rows.groupBy("file", "block").agg(F.sum(total).alias("_n"))
        starts = sums.select("file", "block", F.coalesce(F.sum("_n").over(blocks), F.lit(0)).alias(into))
        return rows.join(hinted(starts, 1_000_000), ["file", "block"])

    rows = from_start(rows, "quotes", "quotes_before")
    inside = (F.col("before") + F.col("quotes_before")) % 2 == 1
    code = F.when(inside, outside(F.regexp_replace("bare", '^[^"]*("|$)', ""))).otherwise(outside(F.col("bare")))
    ends_inside = (F.col("before") + F.col("quotes_before") + F.col("quotes")) % 2 == 1
    rows = rows.select("file", "block", "at", "value", F.when(ends_inside, 0).otherwise(1).alias("closes"), F.regexp_count(code, F.lit(r"\{")).alias("opens"))
    rows = rows.withColumn("moves", F.col("opens") - F.col("closes")).withColumn("depth", F.coalesce(F.sum("moves").over(up_to), F.lit(0)))
    rows = from_start(rows, "moves", "depth_before").withColumn("ends", ((F.col("depth") + F.col("depth_before") + F.col("moves") == 0) & (F.col("closes") == 1)).cast("int"))
    rows = rows.withColumn("done", F.coalesce(F.sum("ends").over(up_to), F.lit(0)))
    rows = from_start(rows, "ends", "done_before").withColumn("row", (F.col("done") + F.col("done_before")).cast("long"))
    made = rows.groupBy("file", "row").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("pieces"), F.max("ends").alias("whole"))
    text = F.regexp_replace(F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), "}"), F.lit("}")), r"^[\s,\[]+", "")
    return made.where("whole = 1").select("file", "row", text.alias("element"))


def event_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON array files in file order (``row``), large files by several tasks.  One file is one match."""
    text = json_elements(spark, path).select(match_of(F.col("file")).alias("match_id"), "row", F.from_json("element", EVENT).alias("e"))
    return text.select("match_id", "row", "e.*")


def metadata(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The first element of each metadata file, a list: (match_id, columns)."""
    return json_elements(spark, path).where("row = 0").select(match_of(F.col("file")).alias("match_id"), F.from_json("element", columns).alias("m")).select("match_id", "m.*")


def facing_right(objects: DataFrame, meta: DataFrame, home_left: str) -> DataFrame:
    """Objects (match_id, x, y) turned by 180 degrees in matches in which home doesn't start on the left, so that home attacks +x in period 1; a match without metadata stays."""
    side = meta.select("match_id", F.when(F.col(home_left), 1.0).otherwise(-1.0).alias("_side"))
    turned = {c: F.col(c) * F.coalesce("_side", F.lit(1.0)) for c in ("x", "y")}
    return objects.join(hinted(side, 1_000_000), "match_id", "left").withColumns(turned).select(*objects.columns)


def _ddl(columns: str) -> str:
    """Top-level column list as struct fields: ``a t`` becomes ``a:t``."""
    out, depth, word = [], 0, ""
    for ch in columns + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            word = ""
        else:
            word += ch
    return ",".join(out)


def restart_of(kind: Column, set_piece: Column) -> Column:
    """Kick-off, end, or the set piece's code but open play."""
    return F.when(kind.isin("FIRSTKICKOFF", "SECONDKICKOFF", "THIRDKICKOFF", "FOURTHKICKOFF"), "K").when(kind == "END", "END").when(set_piece != "O", set_piece)


def parsed_events(rows: DataFrame) -> DataFrame:
    """Shots and goals with team, place and set piece; a goal goes to the team that doesn't kick off next, and none if a free kick follows."""
    after = Window.partitionBy("match_id").orderBy("row").rowsBetween(1, Window.unboundedFollowing)
    g = F.col("gameEvents")
    r = rows.withColumn("restart", restart_of(g["gameEventType"], g["setpieceType"])).withColumn("team", F.when(g["homeTeam"], "home").otherwise("away"))
    nxt = F.first(F.when(F.col("restart").isNotNull(), F.struct("restart", "team")), ignorenulls=True).over(after)
    r = r.withColumn("next", nxt)
    person = F.get(F.filter(F.concat(F.coalesce("homePlayers", F.array()), F.coalesce("awayPlayers", F.array())), lambda p: p["playerId"] == F.coalesce(F.col("possessionEvents.shooterPlayerId"), g["playerId"])), F.lit(0))
    spot = F.coalesce(F.get("ball", F.lit(0)), F.struct(person["x"].alias("x"), person["y"].alias("y")))
    shot = r.where("possessionEvents.possessionEventType = 'SH'")
    scored, against = F.col("possessionEvents.shotOutcomeType") == "G", F.col("next.team") == F.col("team")
    outcome = F.when(scored & (F.col("next.restart") == "F"), "disallowed").when(scored & (F.col("next.restart") == "K") & against, "own_goal").when(scored, "goal").otherwise(F.lower("possessionEvents.shotOutcomeType"))
    return shot.select("match_id", "row", "gameEventId", g["period"].alias("period"), "eventTime", F.lit("shot").alias("event_type"), F.when(outcome == "own_goal", F.when(F.col("team") == "home", "away").otherwise("home")).otherwise(F.col("team")).alias("team"), spot["x"].alias("x"), spot["y"].alias("y"), outcome.alias("outcome"), scalars.named(g["setpieceType"], scalars.SET_PIECES).alias("set_piece"))


def restarts(rows: DataFrame) -> DataFrame:
    """Restarts that open a set play: corners, and free kicks."""
    code = F.col("gameEvents.setpieceType")
    return rows.where(code.isin("C", "F")).select("match_id", F.col("gameEvents.period").alias("period"), F.when(F.col("gameEvents.homeTeam"), "home").otherwise("away").alias("team"), F.col("gameEvents.startGameClock").alias("start_s"), code.alias("code"))


def roster(spark: SparkSession, path: str, home_team: str) -> DataFrame:
    text = spark.read.schema(ROSTER).option("multiLine", True).json(path).select(match_of(F.col("_metadata.file_path")).alias("match_id"), "*")
    return text.select("match_id", F.col("player.id").alias("player_id"), F.when(F.col("team.id") == home_team, "home").otherwise("away").alias("team"), F.col("shirtNumber").cast("long").alias("jersey_number"), F.col("positionGroupType").alias("position"), F.col("player.nickname").alias("name"))


def event_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A CSV with a header and declared types; NaN and empty cells are null, ``Foo [s]`` becomes ``foo``."""
    df = spark.read.schema(columns).option("header", True).option("nullValue", "NaN").option("emptyValue", None).csv(path)
    return df.toDF(*[c.split(" [")[0].strip().lower().replace(" ", "_") for c in df.columns])


def long_objects(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``<name>_x, <name>_y`` columns as rows (keys, object_id, x, y); rows without a position go."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("object_id"), F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y")) for n in names])).alias("o")
    return wide.select(*keys, cells).select(*keys, "o.*").where("x IS NOT NULL AND y IS NOT NULL")


def shots(spark: SparkSession, events: str, freezes: str) -> DataFrame:
    """Shots with their freeze frames: place in metres, outcome, and whether they belong to the open-play population."""
    e = spark.read.schema(SHOT).option("multiLine", True).json(events).select(match_of(F.col("_metadata.file_path")).alias("match_id"), "*")
    f = spark.read.schema(FREEZE).option("multiLine", True).json(freezes)
    s = e.where("type.name = 'Shot'").join(f, e["id"] == f["event_uuid"], "left")
    x, y = G.yards_to_metres(F.element_at("location", 1), F.element_at("location", 2))
    seconds = F.split("timestamp", ":")
    t = seconds[0].cast("double") * 3600 + seconds[1].cast("double") * 60 + seconds[2].cast("double")
    return s.select("match_id", "id", "period", t.alias("t_s"), F.col("team.id").alias("team_id"), x.alias("x"), y.alias("y"), (F.col("shot.type.name") == "Open Play").alias("open_play"), (F.col("shot.outcome.name") == "Goal").alias("goal"), F.col("shot.statsbomb_xg").alias("xg"), "freeze_frame", (F.col("shot.type.name").eqNullSafe("Open Play") & F.col("freeze_frame").isNotNull()).alias("in_population"))


def as_state(shot_rows: DataFrame) -> DataFrame:
    """Each shot as the objects of a frame of its own: ball and shooter at its place, opponents as visible players."""
    def place(loc: Column) -> tuple[Column, Column]:
        return G.yards_to_metres(F.element_at(loc, 1), F.element_at(loc, 2))

    own = F.array(*[F.struct(F.lit(i).alias("object_id"), F.lit(k).alias("object_type"), F.lit(t).cast("string").alias("team"), F.col("x").alias("x"), F.col("y").alias("y")) for i, k, t in (("ball", "ball", None), ("shooter", "player", "home"))])
    them = F.transform(F.filter("freeze_frame", lambda p: ~p["teammate"]), lambda p, i: F.struct(F.concat(F.lit("away_"), i.cast("string")).alias("object_id"), F.when(p["keeper"], "goalkeeper").otherwise("player").alias("object_type"), F.lit("away").alias("team"), place(p["location"])[0].alias("x"), place(p["location"])[1].alias("y")))
    rows = shot_rows.where("in_population").select(F.col("id").alias("match_id"), F.lit(1).cast("long").alias("period"), F.lit(0).cast("long").alias("k"), F.explode(F.concat(own, them)).alias("o"))
    return rows.select("match_id", "period", "k", "o.*", F.lit(None).cast("double").alias("z"), F.lit(True).alias("visible"))


def price_history(spark: SparkSession, path: str) -> DataFrame:
    """(side, t, p) points of ``{home|away: [{t, p}]}`` files."""
    kind = "array<struct<t:double,p:double>>"
    h = spark.read.schema(f"home {kind}, away {kind}").option("multiLine", True).json(path)
    parts = [h.select(F.lit(s).alias("side"), F.explode(s).alias("q")).select("side", "q.t", "q.p") for s in ("home", "away")]
    return parts[0].unionByName(parts[1])
