"""Possession inputs against a plain loop over ticks."""

import math

import numpy as np
import pytest

from gridmark.operators import possession_inputs as P

FRAMES = "match_id string, frame_id long, period long, timestamp_s double, home_attacks_positive_x boolean, native_fps double"
OBJECTS = "match_id string, frame_id long, object_id string, object_type string, team string, x double, y double, visible boolean, interpolated boolean"


def scene(seed, match="m", swapped=False):
    """Two periods at 20 frames a second, jittered, with gaps; players walk, the ball is near one of them or missing."""
    r = np.random.default_rng(seed)
    frames, objects, fid = [], [], 0
    place = {f"{t}_{i}": r.uniform(-30, 30, 2) for t in ("home", "away", "none") for i in range(4 if t != "none" else 1)}
    ball = r.uniform(-20, 20, 2)
    for period in (1, 2):
        t = float(r.uniform(0, 0.3)) + 10 * period
        plus = (period == 1) != swapped
        for i in range(90):
            t += 0.05 + float(r.uniform(-0.01, 0.01)) + (0.13 if i in (23, 24, 60) else 0) + (1.2 if i == 75 else 0)
            fid += 1
            frames.append((match, fid, period, round(t, 6), plus, 20.0))
            ball = ball + r.normal(0, 0.5, 2)
            if i % 15 == 0:
                ball = place["home_1" if i % 30 else "away_2"] + r.normal(0, 0.4, 2)
            for name, xy in place.items():
                xy += r.normal(0, 0.3, 2)
                if r.random() < 0.9:
                    team = name.split("_")[0]
                    team = {"home": "away", "away": "home"}.get(team) if swapped else team
                    side = -1.0 if swapped else 1.0  # the mirrored scene keeps its places and changes teams and directions
                    objects.append((match, fid, name, "goalkeeper" if name.endswith("_0") and team else "player", None if team in ("none", None) else team, side * side * float(xy[0]), float(xy[1]), bool(r.random() < 0.97), bool(r.random() < 0.02)))
            if r.random() < 0.8:
                objects.append((match, fid, "ball", "ball", None, float(ball[0]), float(ball[1]), True, False))
                if r.random() < 0.1:
                    objects.append((match, fid, "ball2", "ball", None, 50.0, 30.0, True, False))
            objects.append((match, fid, "ref", "referee", None, 0.0, 0.0, True, False))
    objects.append((match, 5, "nan", "player", "home", math.nan, 0.0, True, False))
    return frames, objects


def brute(frames, objects):
    """{(period, k): {column: value}} of all columns but the rule's, None for missing."""
    own = {}
    for _, f, o, kind, team, x, y, visible, made in objects:
        if kind != "referee" and visible and not made and math.isfinite(x) and math.isfinite(y):
            own.setdefault(f, []).append((o, kind, team, x, y))
    out = {}
    for period in sorted({f[2] for f in frames}):
        nat, seg, last = [], 0, None
        for _, f, _, t, plus, fps in sorted((f for f in frames if f[2] == period), key=lambda f: (f[3], f[1])):
            ts, d, tol = round(t * 1e6), 1 if plus else -1, round(1.5e6 / fps)
            seg += last is None or ts - last > tol
            last = ts
            o = [(i, k, tm, d * x, d * y) for i, k, tm, x, y in own.get(f, [])]
            balls = sorted(b for b in o if b[1] == "ball")
            nat.append({"f": f, "ts": ts, "seg": seg, "tol": tol, "p": [x for x in o if x[1] != "ball"], "b": balls[0] if balls else None})
        for i, n in enumerate(nat):
            n["w"], n["contact"] = {}, None
            if n["b"] and n["p"]:
                ds = [(math.hypot(p[3] - n["b"][3], p[4] - n["b"][4]), p) for p in n["p"]]
                m = min(d for d, _ in ds)
                labels = {p[2] or "?" for d, p in ds if d <= m + 1e-9}
                n["w"] = {(t, r): (1 / len(labels) if t in labels and (r == "any" or m <= 1.5) else 0) for t in ("home", "away") for r in ("any", "r15")}
                if m <= 1.5:
                    n["contact"] = {"home": 1, "away": -1}.get(next(iter(labels)), 0) if len(labels) == 1 else 0
            follows = i + 1 < len(nat) and nat[i + 1]["seg"] == n["seg"]
            n["hold"] = min(nat[i + 1]["ts"] - n["ts"], n["tol"]) if follows else n["tol"]
        for k in range(-(-nat[0]["ts"] // 100_000), nat[-1]["ts"] // 100_000 + 1):
            t = k * 100_000
            at = [n for n in nat if n["ts"] <= t]
            u = at[-1]
            if t - u["ts"] > u["tol"]:
                continue
            past = [n for n in at if n["seg"] == u["seg"]]
            r = {"seg": u["seg"], "f": u["f"], "players_n": len(u["p"])}
            sights = [n for n in past if n["b"]]
            r["ball_seen"] = float(u["b"] is not None)
            if sights:
                s = sights[-1]
                r["ball_age_s"] = (t - s["ts"]) / 1e6
                if t - s["ts"] <= 1_000_000:
                    r["ball_x"], r["ball_y"] = s["b"][3], s["b"][4]
                for name, w in (("02", 200_000), ("1", 1_000_000)):
                    inside = [x for x in sights if x["ts"] >= t - w]
                    if u["b"] and inside and u["ts"] - inside[0]["ts"] >= w // 2 and all(b["ts"] - a["ts"] <= 500_000 for a, b in zip(inside, inside[1:], strict=False)):
                        span = (u["ts"] - inside[0]["ts"]) / 1e6
                        r[f"ball_vx_{name}"], r[f"ball_vy_{name}"] = (u["b"][3] - inside[0]["b"][3]) / span, (u["b"][4] - inside[0]["b"][4]) / span
            for team in ("home", "away"):
                for name, w in (("05", 500_000), ("1", 1_000_000)):
                    a = max(past[0]["ts"], t - w)
                    for reach in ("any", "r15"):
                        held = sum(n["w"].get((team, reach), 0) * max(0, min(t, n["ts"] + n["hold"]) - max(a, n["ts"])) for n in past)
                        r[f"nearest_{team}_{name}_{reach}"] = held / (t - a) if t > a else None
            touched = [n for n in past if n["contact"] is not None]
            if touched:
                r["last_contact_team"], r["last_contact_age_s"] = touched[-1]["contact"], (t - touched[-1]["ts"]) / 1e6
            xs = [p[3] for p in u["p"]] + ([u["b"][3]] if u["b"] else [])
            if xs:
                r["view_min_x"], r["view_max_x"] = min(xs), max(xs)
            for team, s in (("home", 1), ("away", -1)):
                mine = [p for p in u["p"] if p[2] == team]
                field = [p[3] for p in mine if p[1] == "player"]
                r[f"{team}_visible_n"], r[f"{team}_past_halfway"] = len(mine), sum(s * x > 0 for x in field)
                if mine:
                    r[f"{team}_centroid_x"] = sum(p[3] for p in mine) / len(mine)
                if field:
                    r[f"{team}_max_x"], r[f"{team}_min_x"] = max(field), min(field)
                if u["b"]:
                    ds = sorted((math.hypot(p[3] - u["b"][3], p[4] - u["b"][4]), p) for p in mine)
                    r[f"{team}_within5"], r[f"{team}_within10"] = sum(d <= 5 for d, _ in ds), sum(d <= 10 for d, _ in ds)
                    if ds:
                        r[f"near_{team}_m"] = ds[0][0]
                    if "ball_vx_02" in r and ds:
                        v = (r["ball_vx_02"], r["ball_vy_02"])
                        for name, h in (("03", 0.3), ("05", 0.5)):
                            r[f"heads_{team}_{name}_m"] = min(math.hypot(p[3] - u["b"][3] - h * v[0], p[4] - u["b"][4] - h * v[1]) for p in mine)
                        go = (ds[0][1][3] - u["b"][3], ds[0][1][4] - u["b"][4])
                        if math.hypot(*v) >= 0.5:
                            r[f"heads_{team}_angle"] = math.acos(max(-1, min(1, (v[0] * go[0] + v[1] * go[1]) / math.hypot(*v) / math.hypot(*go))))
                vs = []
                for p in mine:
                    i, first = len(past) - 1, None
                    while i >= 0 and past[i]["ts"] >= u["ts"] - 200_000 and any(q[0] == p[0] and q[2] == team for q in past[i]["p"]):
                        first = next(q for q in past[i]["p"] if q[0] == p[0]), past[i]["ts"]
                        i -= 1
                    if u["ts"] - first[1] >= 100_000:
                        vs.append(-s * (p[3] - first[0][3]) / (u["ts"] - first[1]) * 1e6)
                if vs:
                    r[f"{team}_mean_vx_own"] = sum(vs) / len(vs)
            for c in P.SHAPES:
                if f"home_{c}" in r and f"away_{c}" in r:
                    r[f"diff_{c}"] = r[f"home_{c}"] - r[f"away_{c}"]
            out[period, k] = r
    return out


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and a == pytest.approx(b, rel=1e-5, abs=1e-4))


def test_inputs_equal_the_loop(spark):
    scenes = {f"m{i}": scene(i, f"m{i}") for i in range(3)}
    frames, objects = [f for s in scenes.values() for f in s[0]], [o for s in scenes.values() for o in s[1]]
    rows = P.possession_inputs(spark.createDataFrame(frames, FRAMES).repartition(3), spark.createDataFrame(objects, OBJECTS).repartition(5))
    assert rows.columns == ["match_id", "period", "k", "t_s", "frame_id", "players_n", *P.COLUMNS] and len(P.COLUMNS) == 159
    got = {(r["match_id"], r["period"], r["k"]): r for r in rows.collect()}
    seen = dict.fromkeys(P.BLOCK, 0)
    want = {(m, *key): r for m, s in scenes.items() for key, r in brute(*s).items()}
    assert set(got) == set(want)
    rule = [c for c in P.BLOCK if c.startswith("rule_")]
    for (m, period, k), r in want.items():
        g = got[m, period, k]
        assert g["frame_id"] == r["f"] and g["players_n"] == r["players_n"] and g["t_s"] == pytest.approx(k / 10)
        for c in P.BLOCK:
            if c not in rule:
                assert same(g[c], r.get(c)), (m, period, k, c, g[c], r.get(c))
            seen[c] += g[c] is not None
        for name, n in P.LAGS:
            unbroken = all((m, period, k - i) in want and want[m, period, k - i]["seg"] == r["seg"] for i in range(n + 1))
            for c in P.BLOCK:
                assert same(g[f"{c}_{name}"], got[m, period, k - n][c] if unbroken else None), (m, period, k, c)
    assert min(seen.values()) > 20, seen


def test_inputs_are_causal_and_mirror(spark):
    frames, objects = scene(7)
    f = spark.createDataFrame(frames, FRAMES)
    full = {(r["period"], r["k"]): r for r in P.possession_inputs(f, spark.createDataFrame(objects, OBJECTS)).collect()}
    cut = 11.5
    later = {x[1] for x in frames if x[3] > cut}
    changed = [o if o[1] not in later else (*o[:5], -3 * o[5], o[6], True, False) for o in objects]
    after = {(r["period"], r["k"]): r for r in P.possession_inputs(f, spark.createDataFrame(changed, OBJECTS)).collect()}
    assert all(after[key] == r for key, r in full.items() if key[0] == 1 and r["t_s"] <= cut)
    plain = P.possession_inputs(f, spark.createDataFrame(objects, OBJECTS))
    other = {"home": "away", "away": "home"}
    turned = [(m, i, p, t, not plus, fps) for m, i, p, t, plus, fps in frames]
    swapped = [(*o[:4], other.get(o[4]), *o[5:]) for o in objects]
    want = {(r["period"], r["k"]): r for r in P.possession_inputs(spark.createDataFrame(turned, FRAMES), spark.createDataFrame(swapped, OBJECTS)).collect()}
    mirrored, twice = P.mirrored_inputs(plain), P.mirrored_inputs(P.mirrored_inputs(plain))
    skip = {"ball_y", "ball_vy_02", "ball_vy_1"}  # turning a pitch around turns y as well, mirroring it doesn't
    for r in mirrored.collect():
        assert all(same(r[c], want[r["period"], r["k"]][c]) for c in P.COLUMNS if not any(c.startswith(s) for s in skip)), (r["period"], r["k"])
    for r in twice.collect():
        assert all(same(r[c], full[r["period"], r["k"]][c]) for c in P.COLUMNS)


def test_rule_grid_and_refusals(spark):
    frames, objects = scene(2)
    f, o = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(objects, OBJECTS)
    rule, inputs = P.rule_grid(f, o), P.possession_inputs(f, o)
    both = rule.join(inputs, ["match_id", "period", "k", "frame_id"])
    assert rule.count() == inputs.count() == both.count()
    assert both.where("NOT rule_team <=> CASE rule_possession_team WHEN 'home' THEN 1 WHEN 'away' THEN -1 END OR NOT CAST(carrier_age_s AS FLOAT) <=> rule_carrier_age_s").isEmpty()
    assert not rule.where("ball_carrier_id IS NOT NULL").isEmpty()
    for bad, why in ((frames[:1] + [(*frames[1][:5], 0.0)], "positive declared rate"), ([(*frames[0][:4], None, 20.0)], "home_attacks_positive_x is null")):
        with pytest.raises(Exception, match=why):
            P.possession_inputs(spark.createDataFrame(bad, FRAMES), o).collect()
    assert P.possession_inputs(f.limit(0), o).count() == 0
    alone = P.possession_inputs(f, o.limit(0))
    assert alone.count() == inputs.count() and alone.where("ball_seen <> 0 OR home_visible_n <> 0 OR near_home_m IS NOT NULL OR nearest_home_1_any <> 0").isEmpty()
