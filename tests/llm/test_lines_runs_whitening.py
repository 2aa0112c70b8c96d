"""Line dedup, periodic runs and whitening against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from gridmark.llm import line_dedup, periodic_runs, queries, spectrum, whitening
from tests.llm.test_operators import DOCS, LONG, ODD, WORDS, by_id, frame

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11
def kept_lines(rows, least=20, docs=3):
    """{(doc_id, text): (lines, dropped, kept text)}"""
    holds = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holds[line.strip(" \t\n\x0b\x0c\r").translate(UPPER)].add(-1 if i is None else i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").translate(UPPER) for x in lines]
        stay = [x for x, k in zip(lines, keys, strict=True) if len(k) < least or len(holds[k]) < docs or max(holds[k]) == (-1 if i is None else i)]
        out[i, t] = len(lines), len(lines) - len(stay), "\n".join(stay)
    return out


SHARED = "This line stands in many documents"
LINED = [
    *ODD, SHARED, f"  {SHARED.upper()}\t\nown line of the second document, long enough", f"a\n{SHARED}\n{SHARED} \n\nb", "\n".join([SHARED] * 2), "Ä" * 20, "Ä" * 20 + "\r", "\x0bÄ" + "Ä" * 19, "ä" * 20,
    "short\nshort", "short", "short", "x " * 10, "x " * 10, "x " * 10, "\n\n", "a line in two documents only\n", "a line in two documents only", LONG, LONG + "\n" + SHARED,
]


def test_line_dedup(spark):
    docs = frame(spark, LINED)
    got, want = by_id(line_dedup.digests(line_dedup.judged(docs))), kept_lines(list(enumerate(LINED)))
    for i, t in enumerate(LINED):
        n, dropped, kept = want[i, t]
        assert tuple(got[i])[1:] == (n, dropped, sha(kept)), i
    texts = by_id(line_dedup.without_shared_lines(docs))
    assert line_dedup.without_shared_lines(docs).columns == docs.columns
    assert all(texts[i]["text"] == (None if t is None else want[i, t][2]) for i, t in enumerate(LINED))
    assert line_dedup.digests(line_dedup.judged(docs.limit(0))).count() == 0


def test_line_dedup_cold_keys_and_shared_ids(spark, monkeypatch):
    """Most keys are joined, not broadcast; ids repeat and may be null."""
    monkeypatch.setattr(line_dedup, "MOST_HOT", 3)
    rng = random.Random(3)
    stock = [f"Line number {i} of a stock of lines" for i in range(40)]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choices(stock, k=rng.randint(0, 9)) + [SHARED] * rng.randint(0, 2))) for _ in range(120)]
    rows += rows[:20]
    found = line_dedup.judged(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("whole.*", "n_lines", "n_dropped", "kept").collect()
    want = kept_lines(rows)
    assert len(found) == len(rows)
    assert all((r["n_lines"], r["n_dropped"], r["kept"]) == want[r["doc_id"], r["text"]] for r in found)


def test_line_dedup_equals_sql(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(duckdb.sql(line_dedup.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op11_line_dedup(spark, small).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == want


# 12
def brute_runs(w, least=24, repeats=3):
    """All maximal runs, diagonal by diagonal; a stretch belongs to its smallest period."""
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(least, repeats * q) and not any(all(w[k] == w[k - r] for k in range(s + r, j)) for r in range(1, q)):
                out.append((s, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return [x for i, x in enumerate(w) if i not in gone]


def planted(doc_id, text):
    w, h = WORDS.findall(text or ""), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def periodic(rng):
    out = []
    for _ in range(rng.randint(1, 4)):
        out += rng.choices("abcd", k=rng.randint(0, 12))
        block = rng.choices("abx", k=rng.randint(1, 14))
        out += (block * 40)[: rng.randint(1, 90)]
    return out


def test_runs_of_words():
    rng = random.Random(11)
    texts = [periodic(rng) for _ in range(250)] + [list("a" * 24), list("a" * 23), list("ab" * 12), list("abcdefgh" * 3), list("abcdefgh" * 3)[:-1], list("abcdefghi" * 3), list("aab" * 30 + "aabaab" + "b" * 30)]
    for least, repeats in ((24, 3), (6, 3), (10, 4)):
        docs = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        codes = np.array([ord(c) for t in texts for c in t])
        first = np.append(0, np.cumsum([len(t) for t in texts]))
        got = defaultdict(list)
        for s, length, q in periodic_runs.runs(codes, docs, least, repeats).tolist():
            d = int(docs[s])
            got[d].append((s - int(first[d]), length, q))
        for d, t in enumerate(texts):
            assert got[d] == brute_runs(t, least, repeats), "".join(t)


def test_runs_of_one_word_take_little_time(spark):
    n = 400_000
    [r] = periodic_runs.marked(frame(spark, ["a " * n])).collect()
    assert [tuple(x) for x in r["runs"]] == [(0, n, 1)] and r["collapsed"] == "a"


def test_op12_query(spark, small):
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(periodic(rng)) for _ in range(60)), "  a\tb\n" * 20, "ä ö\x0b" * 15 + "é"]
    docs = frame(spark, texts)
    got = by_id(periodic_runs.digests(periodic_runs.marked(periodic_runs.with_repeated_tails(docs))))
    check_digests(got, list(enumerate(texts)))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))
    whole = by_id(periodic_runs.collapsed_documents(docs))
    assert all(whole[i]["text"] == " ".join(brute_kept(w := WORDS.findall(t or ""), brute_runs(w) if len(w) < 2000 else [])) for i, t in enumerate(texts))
    assert periodic_runs.collapsed_documents(docs).columns == docs.columns
    assert periodic_runs.marked(docs.limit(0)).count() == 0
    [r] = periodic_runs.digests(periodic_runs.marked(periodic_runs.with_repeated_tails(spark.createDataFrame([(None, "a " * 30)], "doc_id long, text string")))).collect()
    assert tuple(r)[:6] == (None, 1, 0, 30, 1, 30_000)


def test_op12_on_the_small_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check_digests(by_id(queries.op12_periodic_runs(spark, small)), [(i, t) for i, t in rows if len(WORDS.findall(t or "")) < 1500])


def check_digests(got, rows):
    for i, t in rows:
        w = planted(i, t)
        found = brute_runs(w) if len(w) < 2000 else []
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert tuple(got[i])[1:] == (len(found), *shown, sha("".join("{},{},{}\n".format(*r) for r in found)), sha(" ".join(brute_kept(w, found)))), i


# 13
def test_inertia_and_leading():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 7, 40):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for values in (rng.normal(size=d) ** 2 * 50, np.repeat(3.0, d), np.concatenate([[9.0, 9.0, 9.0 - 1e-9, 4, 4][:d], np.zeros(max(d - 5, 0))])):
            m = q @ np.diag(values) @ q.T
            m = (m + m.T) / 2
            exact = np.sort(np.linalg.eigvalsh(m))[::-1]
            for s in (-1.0, 0.5, 3.5, 20.0):
                assert spectrum.above(m, s) == (exact > s).sum()
            found = spectrum.leading(m, 4)
            assert len(found) == min(4, (exact > exact[0] * 1e-12).sum())
            for (e, u), w in zip(found, exact, strict=False):
                assert abs(e - w) <= 1e-13 * exact[0] and np.linalg.norm(m @ u - e * u) <= 1e-12 * exact[0]
            u = np.stack([u for _, u in found], axis=1)
            assert np.abs(u.T @ u - np.eye(len(found))).max() < 1e-12
    assert spectrum.leading(np.zeros((3, 3))) == [] and spectrum.leading(np.zeros((0, 0))) == []
    [(e, u), *rest] = spectrum.leading(np.diag([1.0, 5.0, 2.0]))
    assert e == 5 and abs(u[1]) == pytest.approx(1) and [x for x, _ in rest] == [2, 1]
    tiny = spectrum.leading(np.array([[0.0, 1e-200], [1e-200, 0.0]]))
    assert len(tiny) == 1 and tiny[0][0] == pytest.approx(1e-200)


def brute_whitening(rows, k=4):
    good = [(i, np.array([math.floor(256 * float(c)) for c in v], object)) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([list(t) for t in dict.fromkeys(tuple(v) for _, v in good)], object)
    n, s = len(x), x.sum(axis=0)
    centred = (x * n - s).astype(float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return {i: (n, int(((v * n - s) ** 2).sum()), ((v * n - s).astype(float) / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()) for i, v in good}


def check_whitening(got, rows, k=4):
    want, by = brute_whitening(rows, k), defaultdict(dict)
    for r in got:
        by[r["vec_id"]][r["component"]] = r
    assert set(by) == set(want)
    sign = None
    for i, (n, deviation, w, explained) in want.items():
        assert sorted(by[i]) == list(range(1, k + 1))
        mine = np.array([by[i][c]["whitened"] for c in range(1, k + 1)])
        sign = np.where(mine * w < 0, -1, 1) if sign is None and np.abs(w).min() > 1e-3 else sign
        assert all(by[i][c]["n"] == n and by[i][c]["deviation"] == deviation for c in by[i])
        assert [by[i][c]["explained"] for c in range(1, k + 1)] == pytest.approx(list(explained), rel=1e-9)
        assert max(by[i][c]["identity_error"] for c in by[i]) < 1e-9
        if sign is not None:
            assert mine == pytest.approx(w * sign, abs=1e-6)


def test_op13_on_the_small_table(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check_whitening(queries.op13_whitening(spark, small).collect(), rows)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [5, 4, 3, 2, 1, 1]]) for i in range(80)]
    odd = [(100, None), (101, [1.0, None, 1, 1, 1, 1]), (102, [math.nan] * 6), (103, [math.inf] + [0.0] * 5), (104, [-0.0] * 6), (105, [0.0] * 6), (106, rows[0][1]), (107, rows[0][1])]
    kind = "vec_id long, embedding array<float>, x int, n int, component string"
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows + odd]
    df = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows] + [(200, [], 1, 2, "c"), (201, [1.0, 2.0], 1, 2, "c")], kind).repartition(5)
    check_whitening(whitening.whitened(df).collect(), rows)
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id IN (0, 106, 107)")).count() == 0
    assert whitening.whitened(df.where("vec_id IN (0, 1)")).groupBy("component").count().collect() == [(1, 2)]
    large = spark.createDataFrame([(i, [float(i % 3) * 1e6, float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    check_whitening(whitening.whitened(large).collect(), [(i, [float(i % 3) * 1e6, float(i)]) for i in range(9)], k=2)
    assert DOCS
