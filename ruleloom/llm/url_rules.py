"""URL filtering by association rules.

A URL's tokens are its host labels, path segments and query keys. FP-growth
mines, from labelled URLs, which combinations of tokens go with a verdict;
rules are pruned by support and confidence, and a rule is dropped when one
with fewer tokens says the same as surely. A URL is judged by an inverted
index from tokens to rules: a rule fits when all of its tokens have been met;
of the fitting ones the surest wins.

Stated rules (a host suffix and a path prefix) come first: they judge the URLs
they fit, and these verdicts are the labels that the rest is learnt from.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Stated rules: (host, path prefix) to verdict.
RULES = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
#: Least share of the labelled URLs that a combination is in, and least share of these that have the verdict.
SUPPORT, CONFIDENCE = 0.01, 0.8
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def stated(host: Column, path: Column, rules: dict[tuple[str, str], str]) -> tuple[Column, Column]:
    """The longest stated rule that fits, as ``host`` + path prefix, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (h, p), v in sorted(rules.items(), key=lambda r: len(r[0][0]) + len(r[0][1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: ``h:`` host labels, ``p:`` path segments with runs of
    digits as ``#``, ``q:`` query keys."""
    filled = lambda a: F.filter(a, lambda x: x != "")
    h = F.transform(filled(F.split(host, r"\.")), lambda x: F.concat(F.lit("h:"), x))
    p = F.transform(filled(F.split(path, "/")), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    q = F.transform(filled(F.split(query, "&")), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "(?s)^([^=]*)", 1)))
    return F.array_distinct(F.concat(h, p, q))


def vocabulary(rows: DataFrame, least: int = 1) -> dict[str, str]:
    """The tokens that are in ``least`` rows or more, each with the one that
    speaks for it: of tokens that always stand together the least does, so
    that their combinations do not multiply."""
    seen = rows.select(F.explode("t").alias("token"), F.xxhash64("t").alias("r"))
    counts = seen.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("r")).alias("a"), F.sum(F.shiftright("r", 20).cast("decimal(20,0)")).alias("b"))
    speaks: dict[tuple, str] = {}
    # there are at most as many as a row has tokens on average, over the least share
    return {r["token"]: speaks.setdefault((r["n"], r["a"], r["b"]), r["token"]) for r in counts.filter(F.col("n") >= least).orderBy("token").collect()}


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[tuple[str, ...], str, float, float]]:
    """Rules (tokens, verdict, confidence, support) from rows (t: tokens, y:
    verdict), the surest first; see ``learn``."""
    return learn(labelled, support, confidence)[0]


def learn(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[list[tuple[tuple[str, ...], str, float, float]], dict[str, str]]:
    """The rules, and the tokens with the one that speaks for each in them.
    All rows are mined, so that supports and confidences are those of the data;
    the least support alone bounds the tokens."""
    rows = written(labelled.select("t", "y"), "url-labelled")
    n = rows.count()
    if not n:
        return [], {}
    same = vocabulary(rows, math.ceil(support * n))
    words = sorted(set(same.values()))
    items = F.concat(F.filter("t", lambda x: x.isin(words) if words else F.lit(False)), F.array(F.concat(F.lit("y:"), "y")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows.select(items.alias("items")))
    found = model.associationRules.filter(F.get("consequent", F.lit(0)).startswith("y:") & ~F.exists("antecedent", lambda x: x.startswith("y:")))
    rules = [(tuple(sorted(r["antecedent"])), r["consequent"][0][2:], r["confidence"], r["support"]) for r in found.collect()]
    by = {(a, v): c for a, v, c, _ in rules}
    # a rule goes if some of its tokens alone are as sure of the same verdict
    kept = [r for r in rules if not any(by.get((r[0][:k] + r[0][k + 1 :], r[1]), -1) >= r[2] for k in range(len(r[0])))]
    return sorted(kept, key=lambda r: (-r[2], -r[3], len(r[0]), r[0], r[1])), same


def judge(rows: DataFrame, rules: list[tuple[tuple[str, ...], str, float, float]], default: str = DEFAULT, same: dict[str, str] | None = None) -> Column:
    """The verdict of the surest rule that fits column t, by a map from each
    token to the rules it is in; the number of rules is bounded by the
    frequent combinations, not by the data. A token that ``same`` has another
    speak for counts as that one: a rule fits with any token of a group."""
    if not rules:
        return F.lit(default)
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for token in r[0]:
            index.setdefault(token, []).append(i)
    postings = F.create_map(*(x for token, at in index.items() for x in (F.lit(token), F.array(*map(F.lit, at)))))
    sizes, verdicts = F.array(*(F.lit(len(r[0])) for r in rules)), F.array(*(F.lit(r[1]) for r in rules))
    others = [x for token, by in (same or {}).items() if token != by and by in index for x in (F.lit(token), F.lit(by))]
    named = F.transform("t", lambda x: F.coalesce(F.element_at(F.create_map(*others), x), x)) if others else F.col("t")
    met = F.flatten(F.transform(F.array_distinct(named), lambda x: F.coalesce(F.element_at(postings, x), F.array().cast("array<int>"))))
    fits = lambda m: F.array_min(F.filter(F.array_distinct(m), lambda i: F.size(F.filter(m, lambda j: j == i)) == F.get(sizes, i)))
    first = F.get(F.transform(F.array(met), fits), F.lit(0))
    return F.coalesce(F.get(verdicts, first), F.lit(default))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[tuple[str, str], str] | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Returns (id_col, host, path, rule, verdict), a row for each row.

    ``rule`` is the longest stated rule that fits, or null, of equally long
    ones the one stated last; of mined rules that fit the surest one counts,
    then the one with more support, then the shorter one; the verdict is its
    own, else that of the mined rules, else ``allow``. Rules are mined from the
    rows that a stated rule fits. A null url, or one without ``://``, has an
    empty host and path. Null and repeated ids and rows are kept. Other columns
    are not read. An empty table gives an empty result. URLs of any length are
    judged whole.
    """
    rules = RULES if rules is None else rules
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("_u"))
    parts = base.select("id", "_u", host(F.col("_u")).alias("host"), path(F.col("_u")).alias("path"))
    name, verdict = stated(F.col("host"), F.col("path"), rules)
    rows = parts.select("id", "host", "path", name.alias("rule"), verdict.alias("y"), tokens(F.col("host"), F.col("path"), F.coalesce("_u", F.lit(""))).alias("t"))
    mined, same = learn(rows.filter(F.col("y").isNotNull()).select("t", "y"), support, confidence)
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("y", judge(rows, mined, same=same)).alias("verdict"))
