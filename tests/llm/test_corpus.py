"""Packing, spelling variants and the filter audit against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest

from ruleloom.llm import _ids, filter_audit, packing, variants

JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "<|endoftext|> z", "it's\n\n  so\t", "日本語 テキスト 🙂", "x" * 3000, "\x85\xa0 q \x1c", "twice", "twice"]


def docs(spark, rows):
    """Rows (doc_id, text, source) with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "doc_id long, text string, source string, id string, queue string, n int, part int")


# token ids


def test_ids_are_the_librarys():
    encoder = _ids.IdEncoder(JSON)
    assert encoder._fast
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "the", "tion", "ß", "日", "'s", "12", ".", "<|endoftext|>", "　", "zz" * 9, "\x85", "\x1c", "​"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for t in texts:
        assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert "".join(_ids.cut(t, 5)) == t
    long = " ".join(rng.choice(["the", "\nof", "12", "a.b"]) for _ in range(4000))
    parts = [encoder.tokenizer.encode(p, add_special_tokens=False).ids for p in _ids.cut(long, 50)]
    assert len(parts) > 100 and sum(parts, []) == encoder.tokenizer.encode(long, add_special_tokens=False).ids


# packing


def round_robin(totals, quanta, length):
    """The queues served one round after another, then cut."""
    deficit, sent, out = [0] * len(totals), [0] * len(totals), []
    while sum(sent) < sum(totals):
        for i in range(len(totals)):
            if sent[i] < totals[i]:
                deficit[i] += quanta[i]
                k = min(deficit[i] >> packing.FINE, totals[i] - sent[i])
                deficit[i] -= k << packing.FINE
                out += [(i, sent[i] + x) for x in range(k)]
                sent[i] += k
    full, rest = divmod(len(out), length)
    places = [(s, o) for s in range(full) for o in range(length)]
    for bit in range(20, -1, -1):
        if rest >> bit & 1:
            places += [(full, o) for o in range(1 << bit)]
            full += 1
    return dict(zip(out, places, strict=True))


@pytest.mark.parametrize("seed", range(60))
def test_pieces_are_those_of_the_rounds(seed):
    rng = random.Random(seed)
    length = rng.choice([8, 16, 64])
    totals = [rng.randint(1, rng.choice([5, 50, 400])) for _ in range(rng.randint(1, 6))]
    names = {str(i): t for i, t in enumerate(totals)}
    targets = None if seed % 2 else {q: rng.choice([0.01, 1, 3, 0.2]) for q in names}
    quanta = packing.quanta(names, rng.choice([length, 3 * length, 5]), targets)
    mixture, got = packing.Mixture(totals, quanta, length), {}
    for i, t in enumerate(totals):
        at = 0
        while at < t:
            n = rng.randint(1, t - at)
            for p in mixture.pieces(i, at, n):
                for a, k, s, o in p.T.tolist():
                    for x in range(k):
                        assert (i, at + a + x) not in got
                        got[i, at + a + x] = s, o + x
            at += n
    assert got == round_robin(totals, quanta, length)


def test_windows_hold_the_target_shares():
    totals = {"a": 60_000, "b": 30_000, "c": 10_000}
    m = packing.Mixture(list(totals.values()), packing.quanta(totals, 1000, None), 1000)
    sent = np.diff(m.sent(np.arange(-1, 99)), axis=0)
    assert (abs(sent - [600, 300, 100]) <= 1).all()


def test_mixture_of_a_hundred_terabytes():
    """No sum overflows, and a small source's rounds are found without going through all."""
    totals = {"a": 25 * 10**12, "b": 1000}
    m = packing.Mixture(list(totals.values()), packing.quanta(totals, 1024, None))
    p = np.concatenate(list(m.pieces(0, 25 * 10**12 - 5000, 5000)), 1)
    assert p[1].sum() == 5000 and (p[1] > 0).all() and (p[2] >= 0).all()
    assert np.concatenate(list(m.pieces(1, 0, 1000)), 1)[1].sum() == 1000


def check_packing(rows, found, length, key):
    encoder = _ids.IdEncoder(JSON)
    tokens = {k: [*encoder.encode(t or "").tolist(), 0] for k, t in key.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
        ids = tokens[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert set(by_doc) == {r[0] for r in rows}
    for ranges, size in [*((v, len(tokens[k]) * sum(r[0] == k for r in rows)) for k, v in by_doc.items()), *((v, None) for v in by_seq.values())]:
        assert size is None or sum(n for _, n in ranges) == size
        if size is None:
            at = 0
            for o, n in sorted(ranges):
                assert o == at
                at += n
            assert at == length or at < length and at & (at - 1) == 0
    assert sum(sum(n for _, n in v) < length for v in by_seq.values()) <= length.bit_length()


def test_packing_operator(spark):
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice(["tion", "the", "x1"]) for _ in range(rng.randint(0, 400))), "hot") for i in range(60)]
    rows += [(900, "again", "hot"), (900, "again", "hot"), (None, "null id", "hot")]
    key = {r[0]: r[1] for r in rows}
    for targets in (None, {"a": 1.0, "b": 2.0, "": 1.0, "hot": 1.0}):
        found = packing.pack(docs(spark, rows).repartition(3), JSON, length=64, targets=targets).collect()
        check_packing(rows, found, 64, key)
    assert packing.pack(docs(spark, rows).limit(0), JSON).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, rows), JSON, targets={"a": 1.0})


# spelling variants


def brute_words(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    out = {}
    for w, n in words.items():
        some = [x for x in words if near(w, x)]
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 10 * n else None
        out[w] = [form, None, n, len(some), words.get(form)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def corpus(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abné") for _ in range(rng.randint(7, 10))) for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = stems[min(int(rng.expovariate(0.6)), 11)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "B" + w[k + 1 :]])
            words.append(rng.choice([w, w.capitalize(), w + "."]))
        rows.append((i, " ".join(words), "s"))
    return rows


@pytest.mark.parametrize("hot", [variants.HOT, 3])
def test_variants_operator(spark, hot):
    rows = corpus(1, 250) + [(None, "nullify nullify", "s"), (7, None, None), (8, "", "s"), (9, "aaaaaaa aaaaaaaa aaaaaaaaa " * 15 + "B" * 90 + " " + "b" * 90, "s"), (9, "aaaaaaa", "s"), (9, "aaaaaaa", "s")]
    want = brute_variants(brute_words(rows))
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(docs(spark, rows), hot=hot).collect()}
    assert found == want and sum(r[0] is not None for r in want.values()) > 20 and any(r[1] != r[0] for r in want.values() if r[0])
    assert variants.variants(docs(spark, rows).limit(0)).count() == 0


def test_long_text_is_counted_in_steps(monkeypatch):
    text = " ".join(random.Random(1).choice(["several", "another", "Another", "x"]) for _ in range(5000))
    whole = Counter()
    for w, n in variants.words_of(1, text):
        whole[w] += n
    monkeypatch.setattr(variants, "_STEP", 7)
    steps = Counter()
    for w, n in variants.words_of(1, text):
        steps[w] += n
    assert whole == steps == Counter(brute_words([(1, text)]))


@pytest.mark.parametrize("hot", [10**9, 1, 2, 20])
def test_index_loses_no_pair(hot):
    """Words over few letters: grams repeat in a word, lists are long and divided."""
    rng = random.Random(hot)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(350)} | {"".join(rng.choice("aé") for _ in range(rng.randint(10, 14))) for _ in range(250)})
    frequency = Counter(variants.bucket(m, g) for w in words for m in (len(w), len(w) + 1) for g in variants.grams(w))
    index = defaultdict(list)
    for w in words:
        for m in (len(w), len(w) + 1):
            for key, place in variants.postings(w, m, frequency, hot):
                index[m, key].append((place, w, 1))
    found = {(a, b) for (m, _), rows in index.items() for a, _, b, _ in variants.near_pairs(m, rows)}
    assert found == {(a, b) for a in words for b in words if near(a, b)} and len(found) > 500


# filter audit


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    flags = []
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        flags.append((source or "", bad, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                redundant = sum(x[1][f] for x in own) - len(gone)
                left = [x for x in left if not x[1][f]]
                unique = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, unique, sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[f] += len(gone)
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["a", None, ""])) for i, t in enumerate(ODD)]
    for i in range(150):
        n = rng.choice([3, 199, 200, 260])
        words = [rng.choice(["x", "Y", "#", f"w{k}", "Äb"]) if rng.random() < rng.choice([0.05, 0.6]) else f"w{k}" for k in range(n)]
        rows.append((100 + i, rng.choice([" ", "\n", "\x0b "]).join(words), rng.choice(["a", "b", "hot", "hot"])))
    rows += [(rng.randint(0, 500), rng.choice(rows)[1], "hot") for _ in range(60)] + [(None, "twice", "b"), (None, "twice", "b"), (300, "same", "b"), (300, "same", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 250, 2), 4, 4, None]]
    frame = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, n int")
    found = filter_audit.audit(docs(spark, rows), frame).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(got) == len(found) and got == brute_audit(rows, labels)
    assert filter_audit.audit(docs(spark, rows).limit(0), frame).count() == 0
    assert filter_audit.audit(docs(spark, rows), frame.limit(0)).count() == len(found)


def test_swaps_visit_all_orders():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for i in filter_audit.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))
