"""Decontamination, licenses, nearest neighbours and URL rules against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import decontaminate, licenses, nearest, url_rules


def words(t):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode())


def brute(docs, items, size):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for j, s in items:
            q = words(s)
            for win in [q[k : k + size] for k in range(max(1, len(q) - size + 1))] if q else []:
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        ids.add(j)
        ids.discard(None)
        out.append((str(i), len(w), len(hit), len(ids), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("segment,block", [(1_000_000, 200_000), (300, 12)])
def test_contamination(spark, segment, block):
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "Da", "été", "x1"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", ". "]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (None, text(30)), (7, "a b c"), (7, "a b c")]
    items = [(i, text(rng.randint(1, 8))) for i in range(12)] + [(50, None), (51, "!!"), (None, "x1 x1 x1"), (3, "zz yy")]
    d = spark.createDataFrame([(i, t, 0, "s") for i, t in docs], "doc_id long, text string, seg int, ids string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b, window=4, segment=segment, block_words=block).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == brute(docs, items, 4)
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    clean = decontaminate.contamination(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)


def test_keep_clean(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, "zero " + item + " end"), (2, "one two three"), (None, item.upper()), (None, "fine"), (3, "fine"), (3, "fine")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, _h int, _i int")
    kept = decontaminate.keep_clean(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == d.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("2", "one two three"), ("3", "fine"), ("3", "fine"), ("None", "fine")]


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red big fox"), (2, "red fox"), (3, "fox and then far away red")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "red fox")], "item_id long, text string")
    index = decontaminate.build_index(d, None)
    place = index.select("seg", F.posexplode("ids").alias("ord", "doc_id"))
    near = lambda slack: sorted(r["doc_id"] for r in decontaminate.matches(index, i, slack=slack).join(place, ["seg", "ord"]).collect())
    assert near(0) == [2] and near(1) == [1, 2]


def containment(text, template):
    shingle = lambda t: [tuple(w[k : k + 5]) for w in [[x for x in re.split(r"[^\w]+", t.lower()) if x]] for k in range(len(w) - 4)]
    own = set(shingle(template))
    return len(own & set(shingle(text))) / len(own)


def test_licenses(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rows = [(i, filler(rng.randint(0, 60)) + " " + t + "\n" + filler(rng.randint(0, 60))) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    want = {(i, name) for i, (name, _) in enumerate(licenses.TEMPLATES)}
    edited = licenses.TEMPLATES[2][1].replace("documentation", "other")  # one word of 31 shingles' middle
    assert containment(edited, licenses.TEMPLATES[2][1]) >= 0.8
    rows += [(100, filler(80) + " " + edited + " " + filler(9)), (101, None), (102, ""), (103, "too short"), (104, filler(300)), (105, "Licensed under the Apache"), (106, "x " * 300 + "Released under the MIT License. " * 50)]
    want |= {(100, "MIT"), (106, "MIT")}
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows + rows[:3]], "doc_id long, text string, s int, key int")
    got = licenses.scan(df).collect()
    assert want <= {(r["doc_id"], r["license"]) for r in got}
    assert len(got) == len({(r["doc_id"], r["license"]) for r in got})
    text = dict(rows)
    for r in got:  # exact: what is reported is contained
        assert max(containment(text[r["doc_id"]], t) for n, t in licenses.TEMPLATES if n == r["license"]) >= r["containment"] - 1e-9 >= 0.8 - 1e-9
    for i, t in rows:  # and what is contained is reported
        for n, template in licenses.TEMPLATES:
            if t and containment(t, template) >= 0.8:
                assert (i, n) in {(r["doc_id"], r["license"]) for r in got}
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bands_miss_as_rarely_as_stated(spark):
    """Windows of 8 random shingles against a template's 4 (J = 1/2) and 4 of
    its 5 (J = 4/9): the misses of few bands are those of independent ones."""
    n, rng = 20_000, np.random.default_rng(8)
    for own, j in ((4, 1 / 2), (5, 4 / 9)):
        common = rng.integers(-(2**63), 2**63 - 1, (n, 4))
        rest = [rng.integers(-(2**63), 2**63 - 1, (n, k)) for k in (4, own - 4)]
        rows = [(i, *(np.concatenate([common[i], r[i]]).tolist() for r in rest)) for i in range(n)]
        df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>")
        side = lambda c, out, df=df: licenses._banded(df.select("i", F.struct(F.lit(0).alias("p"), F.col(c).alias("h")).alias("x")), 8, 16).select("i", "c", F.col("b").alias(out))
        met = side("a", "u").join(side("b", "v"), ["i", "c"]).filter("u = v")
        for bands in (1, 4, 16):
            missed = 1 - met.filter(F.col("c") < bands).select("i").distinct().count() / n
            want = (1 - j) ** bands
            assert abs(missed - want) < 5 * (want / n) ** 0.5 + 2 / n


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(10, d))[rng.integers(0, 10, n)] + 0.5 * rng.normal(size=(n, d))


def exact(ids, x, queries, k):
    """The k nearest ids of each query, by all pairs; an id has its best score."""
    out = {}
    for q in queries:
        best = {}
        for own in [i for i in range(len(ids)) if ids[i] == q]:
            for i, s in zip(ids, nearest.cosines(x, x[own]), strict=True):
                if i != q:
                    best[i] = max(best.get(i, -2), s)
        out[q] = [i for _, i in sorted((-s, i) for i, s in best.items())[:k]]
    return out


def found(spark, ids, x, queries, **more):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    out = {}
    for r in nearest.nearest(df, F.col("vec_id").isin(queries), **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_of_few_are_exact(spark):
    x = vectors(120, 6, 1)
    x[7] = x[9] = x[11]  # ties go to the smaller id
    rows = [(i, [float(v) for v in r], 1, 2) for i, r in enumerate(x)]
    bad = [(500, None, 1, 2), (550, [0.0] * 6, 1, 2), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 2), (650, [float("nan")] * 6, 1, 2), (700, [1.0, 2.0], 1, 2), (None, [1.0] * 6, 1, 2)]
    df = spark.createDataFrame(rows + bad + rows[50:51] + rows[3:4], "vec_id long, embedding array<double>, id int, leaf int")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == exact(list(range(120)), x, [0, 50, 100], 5)
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    three = spark.createDataFrame(rows[:3], df.schema)
    assert nearest.nearest(three, F.col("vec_id") == 0).count() == 2


def test_recall_of_the_registered_parameters(spark):
    """Directions without any order, which is the hardest case for trees."""
    x = np.random.default_rng(2).normal(size=(20_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = x[::50] @ x.T
    near[np.arange(400), np.arange(0, 20_000, 50)] = -2
    want = np.argsort(-near, axis=1)[:, :5]
    rows = nearest.nearest(df, F.col("vec_id") % 50 == 0).collect()
    hits = sum(r["vec_id"] in want[r["query_id"] // 50] for r in rows)
    assert len(rows) == 2000 and 0.9 <= hits / 2000 < 1
    assert all(abs(r["score"] - near[r["query_id"] // 50, r["vec_id"]]) < 1e-12 for r in rows)


@pytest.mark.parametrize("crowded", [False, True])
def test_leaves_follow_the_data(spark, crowded, monkeypatch):
    """The forest has more leaves than one at a fixture's size; few are taken where
    vectors stand in crowds, many where they have no order. The nodes below
    ``top`` share cuts."""
    rng, n = np.random.default_rng(3), 4000
    x = rng.normal(size=(n, 32)) if not crowded else rng.normal(size=(40, 32)).repeat(n // 40, 0) + 0.05 * rng.normal(size=(n, 32))
    taken, measure = [], nearest.leaves_for

    def leaves_for(groups, forest, *more):
        taken.append((measure(groups, forest, *more), len(forest.value.cuts) << forest.value.depth))
        return taken[-1][0]

    monkeypatch.setattr(nearest, "leaves_for", leaves_for)
    queries = list(range(0, n, 50))
    got, want = found(spark, list(range(n)), x, queries, top=3), exact(list(range(n)), x, queries, 5)
    hits = sum(len(set(got[q]) & set(want[q])) for q in queries)
    (some, of), share = taken[0], hits / (5 * len(queries))
    assert of >= 64 and share >= 0.95
    assert some < 0.1 * of if crowded else some > 0.2 * of


def test_repeated_ids_count_once(spark):
    x = vectors(50, 6, 4)
    x[1:11] = x[0] + 0.01 * np.random.default_rng(1).normal(size=(10, 6))  # all near the query 0
    ids = [0] + [7] * 10 + list(range(100, 139))
    assert found(spark, ids, x, [0, 100]) == exact(ids, x, [0, 100], 5)
    x[2:6], x[20], x[21] = x[1], x[1], x[0]  # the same vector under one id, under another, and the query's own
    assert found(spark, ids, x, [0, 7, 110]) == exact(ids, x, [0, 7, 110], 5)


def test_copies_of_a_third_are_one_candidate(spark):
    x = vectors(300, 6, 5)
    x[::3] = x[0]
    ids, queries = list(range(300)), [0, 3, 150, 50, 299]
    assert found(spark, ids, x, queries) == exact(ids, x, queries, 5)


def test_blocks_and_deep_trees_lose_nothing(spark):
    x = vectors(400, 6, 6)
    ids, queries = list(range(400)), list(range(0, 400, 10))
    assert found(spark, ids, x, queries, leaf=10, leaves=10**6, top=2) == exact(ids, x, queries, 5)
    assert found(spark, ids, x, queries, leaf=200, leaves=10**6, block=30, block_queries=7) == exact(ids, x, queries, 5)


def test_extreme_lengths(spark):
    x = vectors(40, 6, 7)
    x[::2] *= 1e200
    x[::3] *= 1e-250
    assert found(spark, list(range(40)), x, [0, 1, 2]) == exact(list(range(40)), x, [0, 1, 2], 5)


URLS = ["http://a.NET/x", "https://shop.example.net/en/1?q=1#t", "https://example.com/de/", "https://fr.org/fr/9", "http://b.org/en/7?page=2", None, "nothing", "x://", "http://net?x", "http://xnet/", "ftp://example.com/de", "http://h.example.com/en/3#/de/"]


def test_url_parts_and_stated_rules(spark):
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(URLS)], "page_id long, url string, host int, t int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_rules.judge_urls(df).collect()}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fits = [(len(h) + len(p), h + p) for h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, max(fits)[1] if fits else None)
    assert url_rules.judge_urls(df.limit(0)).count() == 0


def test_mined_rules_are_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        t = [f"p:{c}" for c in "abcde" if rng.random() < 0.5]
        rows.append((t, "block" if "p:a" in t and "p:b" in t or rng.random() < 0.05 else "allow"))
    df = spark.createDataFrame(rows, "t array<string>, y string")
    rules = url_rules.mine(df, support=0.05, confidence=0.8)
    for tokens, verdict, confidence, support in rules:
        having = [y for t, y in rows if set(tokens) <= set(t)]
        assert confidence == pytest.approx(having.count(verdict) / len(having))
        assert support == pytest.approx(having.count(verdict) / len(rows))
    assert (("p:a", "p:b"), "block") in {(r[0], r[1]) for r in rules}
    # and none is missing: what is frequent and sure is implied by a rule with some of its tokens that is as sure
    for n in range(1, 6):
        for tokens in combinations([f"p:{c}" for c in "abcde"], n):
            having = [y for t, y in rows if set(tokens) <= set(t)]
            for verdict in ("block", "allow"):
                k = having.count(verdict)
                if k / len(rows) >= 0.05 and k / len(having) >= 0.8:
                    assert any(set(r[0]) <= set(tokens) and r[1] == verdict and r[2] >= k / len(having) - 1e-9 for r in rules)
    judged = df.select("t", url_rules.judge(df, rules).alias("v")).collect()
    for r in judged:
        assert r["v"] == next((v for tokens, v, *_ in rules if set(tokens) <= set(r["t"])), "allow")


def test_tokens_that_always_meet_do_not_multiply(spark):
    df = spark.createDataFrame([([f"p:{k}" for k in range(40)] + [f"p:u{i}"], "block") for i in range(200)] + [(["p:z"], "allow")] * 50, "t array<string>, y string")
    rules = url_rules.mine(df)
    assert 0 < len(rules) < 20


def test_rules_are_mined_from_all_labelled_urls(spark):
    # more URLs than a sample would hold, in few patterns, and verdicts of unequal size
    n, k = 120_000, F.col("id") % 6
    df = spark.range(n).select(F.array(F.concat(F.lit("p:"), k.cast("string"))).alias("t"), F.when(k < 5, "block").otherwise("allow").alias("y"))
    rules = url_rules.mine(df)
    assert {(r[0], r[1]) for r in rules} == {((f"p:{i}",), "block" if i < 5 else "allow") for i in range(6)}
    assert all(r[2] == 1 and r[3] == pytest.approx(1 / 6) for r in rules)


def test_the_support_alone_bounds_the_tokens(spark):
    df = spark.range(8000).select(F.array(F.concat(F.lit("p:"), (F.col("id") % 80).cast("string"))).alias("t"), F.when(F.col("id") % 80 < 40, "block").otherwise("allow").alias("y"))
    assert {r[0][0] for r in url_rules.mine(df)} == {f"p:{i}" for i in range(80)}


def test_any_token_of_a_group_fits_its_rule(spark):
    urls = ["http://a.net/x/y?k=1"] * 30 + ["http://b.example.net/en/z"] * 30
    urls += ["http://c.org/y", "http://c.org/?k=2", "http://c.org/z"]  # no stated rule fits; y and k stood with net and x only
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(df).collect()}
    assert [got[i] for i in (60, 61, 62)] == [(None, "block"), (None, "block"), (None, "allow")]
