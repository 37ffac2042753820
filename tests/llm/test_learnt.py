"""Language and quality by held-out accuracy, WARC by round trip, the pipeline end to end."""

import base64
import functools
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
import zstandard
from pyspark.sql import functions as F

from ruleloom.llm import _common, decontaminate, language_id, quality, simhash, warc

ODD = [None, "", " \n\t", "a", "One two", "The the THE end.", "x\n\nx\n y\x0bz\x0c", "é é | <b> 12 #!", "w " * 500 + "\nlast line\nlast line", "no-space" * 300]


def plain_features(text):
    """The features from their definitions, a character and a word at a time."""
    data = (text or "").encode()
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", data)
    if not words:
        return [0.0] * quality.N_FEATURES
    kinds = [str.islower, str.isupper, str.isdigit, lambda c: c == " ", lambda c: c == "\n", lambda c: c > "\x7f", ".,".__contains__, "!?".__contains__, "#$%&*+=@^~".__contains__, "|<>[]{}\\/_".__contains__, "\"'():;-".__contains__]
    chars = [chr(b) for b in data]
    shares = [sum((c < "\x80" or k is kinds[5]) and k(c) for c in chars) / len(data) for k in kinds]
    low = [w.lower() for w in words]
    n, distinct = len(low), set(low)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(low, low[1:], strict=False))
    most = max(low.count(w) for w in distinct) / n if n >= 3 else 0.0
    rest = [math.log(1 + n) / 10, len(data) / n / 10, min(1, len(data) / n / 40), len(distinct) / n, len(distinct) / n**0.75 if n > 1 else 1, most, repeats / n, 1 - len(set(lines)) / len(lines), len(zlib.compress(data, 1)) / (len(data) + 20), min(1, len(lines) / n * 5), 1 / n]
    return [math.sqrt(x) for x in shares] + rest


def plain_grams(text):
    """Buckets of a text's n-grams and its letters, from the definitions."""
    t = " " + (text or "").lower() + " "
    kept = []
    for i, c in enumerate(t):
        near = t[i - 1 : i] if i else "", t[i + 1 : i + 2]
        if c.isalpha():
            kept.append(ord(c))
        elif any(x.isalpha() for x in near):
            kept.append(32)
    found = {}
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            if n == 1 and kept[i] == 32:
                continue
            m = 0
            for k in range(n):
                m = (m * 0x100000001B3 + kept[i + k] + k + 1) * 0x9E3779B97F4A7C15 % 2**64
            b = (m >> 48) % language_id.BUCKETS
            found[b] = found.get(b, 0) + 1
    return found, sum(c.isalpha() for c in t)


def test_features_are_their_definitions(monkeypatch):
    for cut in (1_000_000, 3):  # also in runs
        monkeypatch.setattr(quality, "runs", functools.partial(_common.runs, most=cut))
        for t in ODD:
            assert quality.features(t) == pytest.approx(plain_features(t), abs=1e-12)


def test_fingerprints_and_postings_in_runs(monkeypatch):
    whole = [simhash.fingerprint(t) for t in ODD]
    monkeypatch.setattr(simhash, "runs", functools.partial(_common.runs, most=3))
    assert [simhash.fingerprint(t) for t in ODD] == whole
    rows = []
    for most in (1_000_000, 3):
        monkeypatch.setattr(decontaminate, "runs", functools.partial(_common.runs, most=most))
        s = decontaminate._Segment(None, pa.string())
        for t in ODD:
            s.add("x", t)
        rows.append(s.row("s").to_pydict())
    assert rows[0] == rows[1] and rows[0]["n_words"][0] == [len(decontaminate.words(t)) for t in ODD]


def test_grams_are_their_definitions():
    texts = [*ODD, "Straße — ΣΟΦΌΣ!! x1y  z", "日本語 テキスト"]
    buckets, doc, letters = language_id.grams(texts)
    for k, t in enumerate(texts):
        found, n = plain_grams(t)
        assert letters[k] == n
        assert dict(zip(*np.unique(buckets[doc == k], return_counts=True), strict=True)) == found
        for run in (1, 2, 7, 10**6):
            counts, n_long = language_id.long_grams(t or "", run)
            assert n_long == n and {b: counts[b] for b in np.nonzero(counts)[0]} == found


def test_a_very_long_text_takes_bounded_memory():
    import tracemalloc

    text = "some words of prose, " * 300_000  # 6 million characters
    tracemalloc.start()
    counts, n = language_id.long_grams(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300_000 * 16 and peak < 8 * len(text)
    model = language_id.Model(["aa", "bb"], np.ones(language_id.BUCKETS), np.random.default_rng(1).normal(size=(language_id.BUCKETS, 2)), np.zeros(2), 1.0)
    both, _ = model.logits([text, "some words of prose, " * 3000], model.table())
    assert both[0] == pytest.approx(both[1], abs=1e-2)


def test_ftrl_is_the_published_update():
    rng = np.random.default_rng(3)
    rows = [(np.array(sorted(rng.choice(40, 5, replace=False))), rng.random(5), int(rng.integers(0, 3))) for _ in range(60)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    z, n = {}, {}

    def weight(i, c):
        v = z.get((i, c), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get((i, c), 0.0))) / alpha + l2)

    for _ in range(3):
        for ids, x, y in rows:
            w = {(i, c): weight(i, c) for i in ids for c in range(3)}
            e = [math.exp(sum(v * w[i, c] for i, v in zip(ids, x, strict=True))) for c in range(3)]
            for i, v in zip(ids, x, strict=True):
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    old = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, c]
                    n[i, c] = old + g * g
    got = language_id.ftrl(rows, 3, alpha, beta, l1, l2, 3)
    assert all(got[i, c] == pytest.approx(weight(i, c), abs=1e-9) for i in range(40) for c in range(3))


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(4)
    logits = 3 * rng.normal(size=(200, 3))
    y = (logits + 4 * rng.normal(size=(200, 3))).argmax(1)
    loss = lambda t: -sum(math.log(math.exp(r[k] / t) / sum(math.exp(v / t) for v in r)) for r, k in zip(logits, y, strict=True))
    best = language_id._temperature(logits, y)
    assert all(loss(best) <= loss(t) + 1e-9 for t in (best * 0.9, best * 1.1, 0.05, 0.5, 1.0, 5.0))


SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["été", "ou", "eau"], "cc": ["sch", "ung", "ei"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def documents(spark, n=240):
    rng = random.Random(1)
    rows = [(i, prose(rng, l := list(SYLLABLES)[i % 3], rng.randint(3, 60)), l) for i in range(n)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !! 34", None), (None, prose(rng, "aa", 9), "aa"), (4, rows[4][1], rows[4][2])]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, id int, score string")


def crc(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def test_language(spark):
    df = documents(spark)
    got = language_id.identify(df).collect()
    assert len(got) == df.count()
    truth = {r["doc_id"]: r["lang"] for r in df.collect()}
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"], 3) == 1)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert language_id.identify(df.limit(0)).count() == 0
    unlabelled = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_penalty_leaves_weights_at_zero():
    rng = np.random.default_rng(1)
    rows = [(np.array([int(rng.integers(0, 50)) + 100 * y, 7]), np.array([1.0, 0.001]), y) for y in (0, 1) for _ in range(100)]
    w = language_id.ftrl(rows, 2, l1=0.5)
    assert (w[7] == 0).all() and np.count_nonzero(w) < 400
    assert all((x @ w[i]).argmax() == y for i, x, y in rows)


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        t = prose(rng, "aa", rng.randint(10, 60)) if good else " ".join(w + "!!" for w in prose(rng, "aa", rng.randint(10, 60)).upper().split())
        rows.append((i, t))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (None, "null id"), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, y int, _id int")
    marks = spark.createDataFrame(labels + labels[:9] + [(902, None), (None, 1), (7, 0)], "doc_id long, quality int")
    got = quality.classify(docs, marks).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (crc(r["doc_id"], 4) == 2)
    assert {r["score"] for r in quality.classify(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), marks).count() == 0
    assert quality.keep_good(docs, marks.limit(0)).count() == len(rows)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and 200 < kept.count() < 250
    good = sorted(str(r["doc_id"]) for r in got if r["predicted"])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == good


def test_weights_and_cut_are_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, "aa", rng.randint(5, 30)) + "!" * rng.randint(0, 40)) for i in range(80)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int("!" * rng.randint(1, 40) not in t)) for i, t in rows], "doc_id long, quality int")
    learn = F.col("doc_id") % 4 != 2
    known = quality.known_labels(marks, "doc_id", "quality", learn)
    pairs = quality._pairs(quality._drawn(docs, known, "doc_id", "text", 50)).collect()
    x, y = np.array([r["d"] for r in pairs]), np.array([r["label"] for r in pairs])
    model = quality.fit(docs, marks, learn=learn, per_class=50)
    p = 1 / (1 + np.exp(-x @ model.weights))
    spread = x.var(0, ddof=1)
    gradient = x.T @ (p - y) / len(y) + quality.REGULARISATION * model.weights * spread
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).mean() + quality.REGULARISATION / 2 * (w * w * spread).sum()
    assert np.abs(gradient).max() < 1e-3  # the optimum of the penalised logistic loss
    assert all(loss(model.weights) <= loss(model.weights + step) for step in 0.3 * rng_steps(len(model.weights)))
    label = {r["doc_id"]: r["quality"] for r in marks.collect() if r["doc_id"] % 4 != 2}
    raw = sorted((float(np.dot(plain_features(t), model.weights)), label[i]) for i, t in rows + rows[:5] if i in label)
    bad = sum(1 - v for _, v in raw)
    want = (raw[bad - 1][0] + next(v for v, _ in raw if v > raw[bad - 1][0] + 1e-9)) / 2
    assert quality.cut(quality.raw_scores(docs, model, "doc_id", "text"), known) == pytest.approx(want, abs=1e-9)


def rng_steps(n):
    return np.random.default_rng(9).normal(size=(20, n))


def test_a_filter_that_learnt_nothing_keeps_all(spark):
    docs = documents(spark)
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(none).count() == docs.count()
    assert quality.keep_good(docs, docs.select("doc_id", F.lit(1).alias("quality"))).count() == docs.count()


def pages(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", rng.choice(["same", "other é", "", None, f"own {i} " + "x" * rng.randint(0, 3000)])) for i in range(200)]
    rows += [(None, None, "same"), (None, "u\r\nv", "only null"), (3, "http://again", rows[3][2]), (500, "", "big " * 200_000)]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, sha int, frame int").repartition(3)


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(df, folder)
    got = warc.read_archives(index, folder).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        again = f is not None and i != f
        want.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", str(f) if again else "None"))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    ids = {r["record_id"] for r in got}
    assert len(ids) == len(got)
    assert all(r["refers_to_record"] in ids for r in got if r["refers_to_record"])
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_repeated_pages_have_records_of_their_own(spark, tmp_path):
    rows = [(1, "u", "x")] * 4 + [(2, "u", "x"), (None, "u", "y"), (None, "u", "y"), (3, "u", ""), (3, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least, revisits in ((0, 1), (1, 1), (2, 0)):
        folder = f"file://{tmp_path}/w{least}"
        got = warc.read_archives(warc.write_archives(df, folder, least=least), folder).collect()
        ids = {r["record_id"] for r in got}
        assert len(got) == len(ids) == len(rows)
        again = [r for r in got if r["record_type"] == "revisit"]
        assert len(again) == revisits and all(r["refers_to"] == 1 and r["refers_to_record"] in ids for r in again)


def test_attempts_do_not_share_a_bundle(spark, tmp_path):
    """Two attempts at one task write beside each other; the index that counts reads its own."""
    _, df = pages(spark)
    folder = f"file://{tmp_path}/w"
    one, two = warc.write_archives(df, folder), warc.write_archives(df.orderBy(F.rand(1)).repartition(3), folder)
    names = [{r["bundle"] for r in i.select("bundle").distinct().collect()} for i in (one, two)]
    assert not names[0] & names[1]
    results = [sorted((str(r["page_id"]), r["payload_digest"], r["record_type"]) for r in warc.read_archives(i, folder).collect()) for i in (one, two)]
    assert results[0] == results[1]


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4000)).alias("html")).repartition(1)
    folder = f"file://{tmp_path}/w"
    out = warc.read_archives(warc.write_archives(df, folder), folder)
    assert len({r["p"] for r in out.select(F.spark_partition_id().alias("p")).collect()}) > 1
    assert out.count() == 300


def test_bundles_are_plain_zstandard_and_seekable(spark, tmp_path):
    _, df = pages(spark)
    folder = f"file://{tmp_path}/w"
    index = {(r["bundle"], r["frame"], r["offset"]): r["record_id"] for r in warc.write_archives(df, folder).collect()}
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    for name in {b for b, *_ in index}:
        bundle = warc.Bundle(fs, f"{root}/{name}")
        data = open(f"{root}/{name}", "rb").read()
        stream = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert stream == b"".join(bundle.frame(k) for k in range(len(bundle.frames)))
        for (b, k, at), ident in index.items():
            if b == name:
                assert bundle.record(k, at)[0]["WARC-Record-ID"] == ident
    assert not [f for f in os.listdir(root) if f.startswith(".part")]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the fixture tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    result = p.run(spark, SMALL).collect()
    assert [k for k, _ in p.STAGES] == ["language", "quality", "near_dedup", "decontamination", "byte_bpe"]
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, SMALL).persist()
        assert kept.columns == columns and kept.count() <= docs.count()
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        docs = kept
    assert {r["doc_id"] for r in result} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in result)
    assert n / 2 < len(result) < n


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, empties, repeats, clashing names and an empty table through all stages."""
    import corpus_pipeline as p

    rng = random.Random(7)
    item = prose(rng, "aa", 30)
    good = [(i, prose(rng, list(SYLLABLES)[i % 3], 40), list(SYLLABLES)[i % 3]) for i in range(90)]
    bad = [(100 + i, " ".join(w + "!!" for w in prose(rng, "aa", 40).upper().split()), "aa") for i in range(60)]
    odd = [(None, prose(rng, "aa", 40), None), (None, prose(rng, "bb", 40), "bb"), (200, None, "aa"), (201, "", "aa"), (202, "  12 ", None), (203, good[3][1], "aa"), good[5], (204, prose(rng, "aa", 40) + " " + item, "aa")]
    schema = "doc_id long, text string, lang string, _dedup_h int, h int, _text string, id int"
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in good + bad + odd], schema)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + [(None, 1), (5, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    got = [r["doc_id"] for r in p.run(spark, f"{tmp_path}/a").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [i for i, *_ in good] + [None, None]))
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        assert stage(spark, docs, f"{tmp_path}/a").columns == docs.columns
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{t}.parquet").write.parquet(f"{tmp_path}/b/{t}.parquet")
    empty = p.run(spark, f"{tmp_path}/b")
    assert empty.count() == 0 and empty.columns == p.run(spark, f"{tmp_path}/a").columns


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the fixture tables")
def test_queries_with_sql(spark):
    import duckdb

    from ruleloom.llm import entries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name, sql in entries.ORACLE_SQL.items():
        df = entries.QUERIES[name](spark, SMALL)
        rel = con.sql(sql)
        columns = sorted(df.columns)
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(str(tuple(r[k] for k in at)) for r in rel.fetchall())


def test_every_label_is_drawn_at_any_size(spark):
    """A label of 10 ** 9 keys, as its count has it, keeps its share; one whose
    rows are nearly all copies of a text keeps its other texts."""
    from ruleloom.llm import _common

    assert abs(_common.share_of(400, 10**9) * 10**9 - 500) < 1e-6
    hashes = spark.range(1 << 20).select(F.xxhash64("id").alias("h"))
    share = 300 / (1 << 20)
    assert 200 < hashes.filter(_common.below(F.col("h"), share)).count() < 400
    assert hashes.filter(_common.below(F.col("h"), 1.0)).count() == 1 << 20
    assert hashes.filter(_common.below(F.col("h"), 1e-30)).count() == 0
    rows = [("hot", "copy")] * 20_000 + [("hot", f"t{i}") for i in range(30)] + [("small", f"s{i}") for i in range(5)] + [("big", f"b{i}") for i in range(8000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    drawn, labels = _common.class_sample(df, F.xxhash64("text"), "lang", 40)
    n = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.count_distinct("text").alias("n")).collect()}
    assert labels == ["big", "hot", "small"] and n["small"] == 5 and n["hot"] == 31 and 25 <= n["big"] <= 80
