"""Token counts, byte-level BPE and SimHash against the libraries and brute force."""

import hashlib
import random
import time

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from ruleloom.llm import _common, _graph, _ids, byte_bpe, simhash, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  a  b ", "it's we'll", "x\n\n y\t", "日本語 テキスト 🙂", "a" * 300, "<|endoftext|> z", "1234 56", "\x85\xa0 q", "ab" * 500]


def texts(n=300):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "the", "tion", "ß", "日", "'s", "12", ".", "<|endoftext|>", "\u3000", "zz" * 9]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def table(spark, rows):
    """Rows (doc_id, text) with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, id string, _text int, n_tokens int").drop("nothing")


ROWS = [*enumerate(texts(40)), (None, "null id"), (900, None), (900, None), (901, "twice"), (901, "twice")]


def plain(text):
    return len(_ids.load(JSON).tokenizer.encode(text, add_special_tokens=False))


def test_encoder_is_the_library():
    import tiktoken

    bpe = byte_bpe.load(RANKS, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for t in texts(1500):
        ids = bpe.encode(t)
        assert ids == lib.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_backtracking_is_the_merges():
    bpe = byte_bpe.load(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(1500):
        piece = bytes(rng.choice(b"abehinot\xc3\xa9") for _ in range(rng.randint(1, 25)))
        assert bpe.encode_piece(piece) == bpe.merged(piece)


def test_memo_keeps_what_is_used():
    m = byte_bpe.Memo(2)
    for k in range(10):
        m.put(k, k)
        m.put("hot", m.get("hot") or 7)
    assert m.get("hot") == 7 and len(m.young) <= 2


def test_bpe_operator(spark):
    got = byte_bpe.encode_decode(table(spark, ROWS), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ROWS)
    want = sorted((str(i), (t or "").encode()) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in got) == want
    digests = byte_bpe.encode_decode(table(spark, ROWS), RANKS, public_tokenizers.PATTERN, digests=True)
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in digests.collect()) == sorted((i, hashlib.sha256(b).hexdigest()) for i, b in want)
    assert byte_bpe.encode_decode(table(spark, ROWS).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(50_000, 500), (120, 8)])
def test_token_counts(spark, chunk, overlap):
    long = " ".join(random.Random(3).choices(["word", "la", "foo.", "x\n y", "日本", "it's", "<|endoftext|>"], k=900))
    rows = [*ROWS, (950, long), (951, "z" * 700), (952, long), (952, long), (None, long), (953, "日本" * 200 + " a b")]
    got = token_counts.count_tokens(table(spark, rows), JSON, chunk=chunk, overlap=overlap).collect()
    want = sorted((str(i), len((t or "").encode()), plain(t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.count_tokens(table(spark, rows).limit(0), JSON).count() == 0


@pytest.mark.parametrize("kind", ["string", "decimal(20,3)", "date", "double", "binary"])
def test_token_counts_keep_every_row(spark, kind):
    """Ids of any type, in a second round too: one overlap has no boundary."""
    hard = "it's " + "z" * 300 + " " + " ".join(["word"] * 60)
    rows = [("it's \\ a\t\x01", hard), ("plain", hard + "!"), ("plain", hard + "!"), ("small", "a b"), (None, hard), (None, None)]
    ids = {"string": None, "decimal(20,3)": "7.125", "date": "2020-02-03", "double": "0.1", "binary": "\u00ff"}
    df = spark.createDataFrame([(i if ids[kind] is None or i is None else ids[kind], t) for i, t in rows], "doc_id string, text string")
    df = df.withColumn("doc_id", F.col("doc_id").cast(kind))
    got = token_counts.count_tokens(df, JSON, chunk=120, overlap=8).collect()
    if kind in ("string", "binary"):
        own = {(r["doc_id"], r["text"]) for r in df.collect()}
        assert {r["doc_id"] for r in got} == {i for i, _ in own}
    assert sorted(r["n_tokens"] for r in got) == sorted(plain(t or "") for _, t in rows)


def boundaries(text):
    """Where the library's own pre-tokenizer begins pieces."""
    pieces = _ids.load(JSON).tokenizer.pre_tokenizer.pre_tokenize_str(text)
    return {a for _, (a, _) in pieces}


def test_proven_boundaries_are_the_librarys():
    rng = random.Random(7)
    bits = ["the", "ß", "日本", "我", "的", "，", "。", "「", "'s", "'", "12", "½", ".", ";", " ", "  ", "\n", "\r\n", "\t", "\xa0", "\u3000", "́", "\u0558", "\U0001f642", "-", "’", "ア", "ー"]
    seen = 0
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=12))
        at = {m.start() for m in token_counts.PROVEN.finditer(text)} - {0, len(text)}
        assert at <= boundaries(text), text
        seen += len(at)
    assert seen > 10_000


SPACELESS = {
    "chinese": "".join(random.Random(8).choices("我們的語言沒有空格，。；「」", k=6000)),
    "lines": "\n".join(random.Random(8).choices(["word", "Zeile", "mot", "12"], k=1200)),
    "marks": " ".join(["a, b. c;"] * 700),
    "no marks": " ".join(["a,", "(b)", "c;"] * 700),
}


@pytest.mark.parametrize("kind", SPACELESS)
def test_texts_without_words_are_spread(spark, kind):
    text, sizes = SPACELESS[kind], []
    got = token_counts.count_tokens(table(spark, [(1, text)]), JSON, chunk=100, overlap=70).collect()
    assert got[0]["n_tokens"] == plain(text)
    # in one round: no overlap fails
    starts = list(range(0, len(text) - 70, 100))
    assert len(starts) > 40
    for a in starts[1:]:
        sizes.append(sum(1 for _ in token_counts.PROVEN.finditer(text, a + 13, a + 57)))
    assert min(sizes) > 0


def test_only_a_failed_overlap_is_widened():
    starts, widths, todo = token_counts.relaid([0, 100, 200, 300], [5, 5, 5, 5], [1])
    assert (starts, widths, todo) == ([0, 100, 200, 300], [5, 50, 5, 5], [False, True, True, False])
    starts, widths, todo = token_counts.relaid(starts, widths, [1])
    assert (starts, widths, todo) == ([0, 100, 300], [5, 5, 5], [False, True, False])
    assert token_counts.relaid([0, 100], [5, 5], [0])[0] == [0]


def test_counts_after_several_rounds(spark):
    """Runs of letters that are longer than an overlap, a wider one, and a chunk."""
    rng = random.Random(9)
    parts = [" ".join(rng.choices(["to", "of", "12"], k=150)), "z" * 40, "of it", "y" * 700, "x" * 2500, "it's", "w" * 90, "end " * 100]
    text = " ".join(parts)
    rows = [(1, text), (2, text[::-1]), (3, "q" * 5000), (4, text), (5, "'" * 900 + "s" * 900)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(table(spark, rows), JSON, chunk=100, overlap=10).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_encoder_is_linear_and_merges_of_long_pieces():
    bpe = byte_bpe.load(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for n in (1, 2, 5, 60, 300):
        for _ in range(40):
            piece = bytes(rng.choice(b"abehinot\xc3\xa9") for _ in range(n))
            assert bpe._merged_long(piece) == bpe.merged(piece) == bpe.encode_piece(piece)
    took = []
    for n in (100_000, 400_000):
        piece = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)).encode()
        bpe.encode_piece(piece[:50_000])
        began = time.process_time()
        ids = bpe.encode_piece(piece)
        took.append(time.process_time() - began)
        assert bpe.decode(ids) == piece
    assert took[1] < 8 * took[0]  # quadratic: 16 times


def test_long_texts_are_encoded_in_runs():
    bpe = byte_bpe.load(RANKS, public_tokenizers.PATTERN)
    for t in texts(300):
        assert "".join(byte_bpe.long_runs(t, 5)) == t
        assert b"".join(bpe.encode_packed(r) for r in byte_bpe.long_runs(t, 5)) == bpe.encode_packed(t)


def fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [None, *texts(200), "One Two", "a b c", "Éa B\x0bC D \x1c e"]:
        assert simhash.fingerprint(t) & (2**64 - 1) == fingerprint(t)


def classes(values):
    """Least member of each value's component, by all pairs."""
    part = {v: v for v in values}
    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= 3 and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = {k: low if p == high else p for k, p in part.items()}
    return part


def test_links_are_brute_force(spark):
    """Chains at one, two, three and four bits, a dense crowd, and strangers."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:25]:
        x = base
        for _ in range(4):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                x ^= 1 << b
            prints.add(x)
    crowd = rng.getrandbits(64)
    prints |= {crowd ^ rng.getrandbits(7) for _ in range(100)} | {0, 1, 2**63}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    df = spark.createDataFrame([(signed(v),) for v in prints], "fp long")
    want = classes(prints)
    groups = lambda part: sorted(sorted(k for k in part if part[k] == p) for p in set(part.values()))
    for hot in (simhash.HOT, 1, 0):  # divided keys lose nothing
        got = {r["node"] & (2**64 - 1): r["root"] for r in simhash.roots(df, hot=hot).collect()}
        assert groups(got) == groups(want)


def test_a_crowd_costs_no_squares(spark):
    """40,000 fingerprints with one half in common, of several components,
    beside as many strangers: only what may link meets."""
    rng = random.Random(6)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    half = rng.getrandbits(32) << 32
    crowd = {signed(half | rng.getrandbits(32)) for _ in range(40_000)}
    strangers = {signed(rng.getrandbits(64)) for _ in range(40_000)}
    took = []
    for prints in (strangers, crowd):
        df = spark.createDataFrame([(v,) for v in prints], "fp long").persist()
        df.count()
        start = time.monotonic()
        assert simhash.roots(df).count() == len(prints)
        took.append(time.monotonic() - start)
    assert took[1] < 3 * took[0] + 20  # all pairs would be 800 million


def test_near_duplicates_and_dedup(spark):
    base = " ".join(random.Random(5).choices(["ab", "cd", "ef", "gh", "ij", "kl"], k=400))
    rows = [(5, base), (3, base + " x"), (9, base.upper()), (7, "other words stand here"), (None, base), (11, ""), (12, None), (13, " \n"), (20, "one two"), (20, "one two")]
    df = table(spark, rows)
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    part = classes({fingerprint(t) for _, t in rows})
    for i, t in rows:
        same = [j for j, u in rows if part[fingerprint(u)] == part[fingerprint(t)] and j is not None]
        v = fingerprint(t)
        assert got[i, v - 2**64 if v >= 2**63 else v] == min(same)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(part.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0
    only_null = df.filter(F.col("doc_id").isNull())
    assert simhash.deduplicate(only_null.union(only_null)).count() == 1


def test_simhash_sends_no_table_through_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, " ".join(str(rng.randrange(50)) for _ in range(12))) for k in range(60)]
    df = spark.createDataFrame([*rows, (60, rows[0][1]), (61, rows[1][1])], "doc_id long, text string")
    plans = []

    def noted(df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return _common.written(df, name, **options)

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(_graph, "written", noted)
    out = simhash.near_duplicates(df)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 62
    assert sum("SortMergeJoin" in p for p in plans) >= 7  # the eighth is of deduplicate
    assert not [p for p in plans if "Broadcast" in p]
    plans.clear()
    kept = simhash.deduplicate(df)  # the pipeline's stage
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert kept.count() == 60 and "SortMergeJoin" in plans[-1]
    assert not [p for p in plans if "Broadcast" in p]
