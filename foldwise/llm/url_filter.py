"""URL filter: a ratio of two character language models behind host rules.

Rules decide where one fits (its host or a subdomain, and a path prefix; the
longest rule wins). URLs decided by a rule teach two variable-order Markov
models of characters, one of accepted and one of rejected URLs: the probability
of a character after the longest context interpolates with that after ever
shorter ones (Witten-Bell weights: counts against distinct successors) down to a
uniform distribution. Every other URL is judged by the difference of the two
log-likelihoods per character against a threshold calibrated on held-out rule
URLs (page ids with crc32 mod 5 = 0, which the models do not learn from).

The models see the text after "://" without the registered name's last two
labels, which the rules themselves consume, so that they learn the rest of the
URL. Counts of n-grams live in ``slots`` hashed cells per class and order, summed
by Spark over all rule URLs; the table (at most 2 x orders x slots cells) is the
only thing that reaches the driver and is broadcast.

Defined results: a null URL or one without "://" has an empty host and path, no
rule, and is judged by the models on the empty text: log-likelihood difference 0
(allowed exactly if 0 is not below the threshold). If either class has no rule
URL to learn from, every URL without a rule is allowed. Repeated rows repeat; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod5, map_batches

#: Fixed rules: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))
ORDER = 4
SLOTS = 1 << 15
ALPHABET = 257  # bytes and the end


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer rules wrap shorter ones
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def learned_text(url: Column) -> Column:
    """What the models read: host without its last two labels, path, query and fragment."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_replace(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                            r"^((?:[^/?#]*\.)?)[^./?#]+\.[^./?#]+(?=[/?#]|$)", "$1")


def gram_cells(raw: bytes, order: int = ORDER, slots: int = SLOTS) -> Iterator[tuple[int, int, int]]:
    """(order, context cell, next symbol) at every position; the cell hashes the context."""
    padded = b"\x02" * order + raw
    for i in range(len(raw) + 1):
        sym = raw[i] if i < len(raw) else 256
        for o in range(order + 1):
            yield o, xxhash.xxh3_64_intdigest(padded[i + order - o:i + order]) % slots, sym


class CharModel:
    """Interpolated character model of one class, from counts {(order, cell, symbol): n}."""

    def __init__(self, counts: dict[tuple[int, int, int], int], order: int, slots: int):
        self.counts, self.order, self.slots = counts, order, slots
        self.total: dict[tuple[int, int], int] = {}
        self.kinds: dict[tuple[int, int], int] = {}
        for (o, cell, _), n in counts.items():
            self.total[o, cell] = self.total.get((o, cell), 0) + n
            self.kinds[o, cell] = self.kinds.get((o, cell), 0) + 1

    def log_likelihood(self, raw: bytes) -> float:
        out = 0.0
        p = 1.0 / ALPHABET
        for o, cell, sym in gram_cells(raw, self.order, self.slots):
            if o == 0:
                p = 1.0 / ALPHABET
            n = self.total.get((o, cell), 0)
            if n:
                k = self.kinds[o, cell]
                p = (self.counts.get((o, cell, sym), 0) + k * p) / (n + k)
            if o == self.order:
                out += np.log(p)
        return float(out)


def count_cells(urls: DataFrame, order: int = ORDER, slots: int = SLOTS) -> DataFrame:
    """(accepted, order, cell, symbol, n) over all rows (accepted boolean, text binary).

    A Python task adds up the cells of its partition (a bounded number), Spark the rest.
    """

    def run(batches):
        seen: dict[tuple, int] = {}
        for b in batches:
            for ok, raw in zip(b.column("accepted").to_pylist(), b.column("text").to_pylist(), strict=True):
                for cell in gram_cells(raw, order, slots):
                    key = (ok, *cell)
                    seen[key] = seen.get(key, 0) + 1
        cols = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            cols, (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
            ["accepted", "gram", "cell", "symbol", "n"])

    part = map_batches(urls, run, "accepted boolean, gram int, cell int, symbol int, n long")
    return part.groupBy("accepted", "gram", "cell", "symbol").agg(F.sum("n").alias("n"))


def calibrate(accepted: list[tuple[float, int]], rejected: list[tuple[float, int]]) -> float:
    """The threshold with the best balanced accuracy on (binned ratio, count) of held-out URLs.

    Of equally good ones the smallest absolute value; 0 without held-out URLs of both classes.
    """
    if not accepted or not rejected:
        return 0.0
    a, r = sum(n for _, n in accepted), sum(n for _, n in rejected)
    ok, bad = dict(accepted), dict(rejected)
    cuts = sorted({*ok, *bad})
    kept, thrown, best = a, 0, []
    for c in cuts:  # everything below c is rejected
        best.append((-(kept / a + thrown / r), abs(c), c))
        kept -= ok.get(c, 0)
        thrown += bad.get(c, 0)
    best.append((-(kept / a + thrown / r), abs(cuts[-1]) + 0.01, cuts[-1] + 0.01))
    return min(best)[2]


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                order: int = ORDER, slots: int = SLOTS) -> DataFrame:
    """page_id, host, path, rule, verdict, log_ratio (per character) of every row."""
    spark = pages.sparkSession
    base = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       learned_text(F.col("url")).cast("binary").alias("text"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": verdict})
    taught = base.where("rule is not null").select(
        (F.col("ruled") == "allow").alias("accepted"), "text", (crc_mod5(F.col("page_id")) == 0).alias("held"))
    # at most 2 classes x (order + 1) x slots x 257 symbols cells, in practice the few that URLs use
    cells = {True: {}, False: {}}
    for r in count_cells(taught.where("not held").drop("held"), order, slots).collect():
        cells[r["accepted"]][r["gram"], r["cell"], r["symbol"]] = r["n"]
    shared = spark.sparkContext.broadcast(cells)

    def ratio(batches):
        c = shared.value
        usable = bool(c[True]) and bool(c[False])
        models = {k: CharModel(v, order, slots) for k, v in c.items()} if usable else {}
        for b in batches:
            out = [(models[True].log_likelihood(raw) - models[False].log_likelihood(raw)) / (len(raw) + 1)
                   if usable and raw else 0.0 for raw in b.column("text").to_pylist()]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.float64())],
                                             [*names, "log_ratio"])

    held = map_batches(taught.where("held").drop("held"), ratio, "accepted boolean, log_ratio double")
    bins = held.groupBy("accepted", (F.floor(F.col("log_ratio") * 100) / 100).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")).collect()  # bounded: log-ratios are limited by the smoothing
    threshold = calibrate([(r["bin"], r["n"]) for r in bins if r["accepted"]],
                          [(r["bin"], r["n"]) for r in bins if not r["accepted"]])
    if not cells[True] or not cells[False]:
        threshold = 0.0
    scored = map_batches(base, ratio, "page_id long, host string, path string, rule string, ruled string, log_ratio double")
    by_model = F.when(F.col("log_ratio") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "log_ratio")
