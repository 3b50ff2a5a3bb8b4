"""Content-defined units against brute force, and rows that repeat or have clashing columns."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from foldwise.llm import packing, unit_dedup
from foldwise.llm.exact_dedup import drop_exact_copies
from foldwise.llm.near_dedup import keep_one_of_each

ROWS = [(1, None), (2, ""), (3, "few words"), (None, " ".join(f"n{i}" for i in range(200)))]


def plain_units(text):
    """(first word, words) of a text's units and the code points before its words, through the operator's own marks."""
    w = unit_dedup.Words([text.encode()])
    starts, ends = w.units()
    words = text.encode().lower().split()
    return [(int(s), tuple(words[s:e])) for s, e in zip(starts, ends, strict=True)]


def brute(rows):
    """(doc_id, word) -> (keep_doc_id, keep_word, cluster_size) of the removed units: all pairs of different units compared, but
    for those that first stand over each other in one document."""
    places = sorted({(i, t, s, ws) for i, t in rows for s, ws in plain_units(t)}, key=lambda p: (p[0], p[2]))
    kinds = sorted({p[3] for p in places})
    sets = [set(zip(*(k[i:] for i in range(5)), strict=False)) for k in kinds]
    root = list(range(len(kinds)))
    first = {}
    for i, _, at, ws in places:
        first.setdefault(ws, (i, at, at + len(ws)))

    def over(a, b):
        return a[0] == b[0] and a[1] < b[2] and b[1] < a[2]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both) and not over(first[kinds[i]], first[kinds[j]]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    at = {k: find(i) for i, k in enumerate(kinds)}
    clusters = collections.defaultdict(list)
    for i, _, s, ws in places:
        clusters[at[ws]].append((i, s, len(ws)))
    out = {}
    for c in clusters.values():
        i, s, n = c[0]
        out |= {(d, w): (i, s, len(c)) for d, w, _ in c[1:] if not (d == i and w < s + n)}
    return out


def corpus(rnd, n):
    own = lambda k: [f"o{rnd.random()}" for _ in range(k)]
    passages = [[rnd.choice([f"é{k}x{i}", f"P{k}y{i}", "the"]) for i in range(rnd.randint(51, 90))] for k in range(4)]
    rows = []
    for i in range(n):
        p = list(rnd.choice(passages))
        if rnd.random() < 0.4:
            p[rnd.randrange(len(p))] = "changed"
        w = own(rnd.randint(0, 80)) + p + own(rnd.randint(0, 80)) + (p if rnd.random() < 0.2 else [])
        per = rnd.choice([7, 13, 10_000])  # wrapped into short lines, or inside one long line
        rows.append((i, "\n".join(" ".join(w[j:j + per]) for j in range(0, len(w), per))))
    return rows, passages


def test_units_depend_on_the_words_nearby():
    rnd = random.Random(1)
    for _ in range(200):
        shared = [rnd.choice([f"p{rnd.random()}", "the", "of"]) for _ in range(unit_dedup.PASSAGE_WORDS)]
        texts = [" ".join([f"o{rnd.random()}" for _ in range(rnd.randint(0, 60))] + shared + [f"o{rnd.random()}" for _ in range(rnd.randint(0, 60))])
                 for _ in range(2)]
        a, b = ({ws for _, ws in plain_units(t)} for t in texts)
        assert a & b
        assert all(unit_dedup.MIN_WORDS <= len(ws) <= unit_dedup.MIN_WORDS + unit_dedup.END_WINDOW for ws in a | b)
    # the texts of a batch do not change each other's units, nor do parts
    batch = unit_dedup.Words([t.encode() for t in texts])
    starts, _ = batch.units()
    assert [int(s - batch.first[batch.text[s]]) for s in starts] == [s for t in texts for s, _ in plain_units(t)]


def test_tuned_bands():
    bands, rows = unit_dedup.tune_bands()
    assert (1 - 0.75**rows) ** bands <= unit_dedup.MISS and bands == min(b for b, _ in [unit_dedup.tune_bands(most_rows=k) for k in (1, 2, 3)])


def test_repeated_units_equal_brute_force(spark):
    rows, _ = corpus(random.Random(3), 60)
    rows.append(rows[5])  # a repeated row is the same document
    docs = spark.createDataFrame(rows + [r for r in ROWS if r[1] is not None and r[0]], "doc_id long, text string")
    text, want = dict(rows), brute(rows)
    got = {}
    for r in unit_dedup.repeated_units(docs).collect():
        got[r.doc_id, r.word] = (r.keep_doc_id, r.keep_word, r.cluster_size)
        t = text[r.doc_id]
        assert t[r.start:r.start + r.n_chars].split() == t.split()[r.word:r.word + r.n_words]
        assert t.encode()[r.byte:r.byte + r.n_bytes].decode() == t[r.start:r.start + r.n_chars]
    # equal units always meet; similar ones but for the tuned chance
    assert len(set(got.items()) ^ set(want.items())) <= 0.05 * len(want) and len(want) > 60


def test_passages_are_cut_once(spark):
    rows, passages = corpus(random.Random(4), 50)
    docs = spark.createDataFrame([(i, t, len(t), "x", "y") for i, t in rows], "doc_id long, text string, n_chars long, _gone string, _spans string")
    left = {r.doc_id: r for r in unit_dedup.without_repeated_units(docs).collect()}
    assert left.keys() == dict(rows).keys() and all(r.n_chars == len(r.text) and (r._gone, r._spans) == ("x", "y") for r in left.values())
    kept = [r.text.split() for r in left.values()]
    for p in passages:
        whole = sum(any(w[i:i + 50] == p[j:j + 50] for i in range(len(w)) for j in range(len(p) - 49) if w[i:i + 1] == p[j:j + 1]) for w in kept)
        assert whole <= 1
    # own words go only where a unit is similar to another's, not equal: one or two at its ends
    own = {w for t in dict(rows).values() for w in t.split() if w.startswith("o0.")}
    lost = own - {w for k in kept for w in k}
    assert len(lost) < 0.05 * len(own)
    shared = {w for p in passages for w in p}
    assert shared <= {w for k in kept for w in k}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in ROWS], "doc_id long, text string, word string, item string, bands string")
    assert unit_dedup.repeated_units(docs).count() == 0 and unit_dedup.without_repeated_units(docs).count() == len(ROWS)
    assert sorted(map(str, unit_dedup.without_repeated_units(docs).collect())) == sorted(map(str, docs.collect()))
    assert unit_dedup.without_repeated_units(docs.limit(0)).count() == 0
    long = " ".join(f"w{i % 3001}" for i in range(40_000))  # one long text that repeats itself
    got = unit_dedup.without_repeated_units(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().text.split()
    assert len(got) < 1.5 * 3001 and got[:2900] == long.split()[:2900]  # a few words between units stay


CLASH = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, _gone string, _gone_text string, text_hash string"


def test_rows_with_clashing_columns_go_by_id_and_text(spark):
    t, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, t, "en", "s", 1, "p", "q", "r", "u"), (2, t, "en", "s", 1, "p", "q", "r", "u"), (2, other, "en", "s", 1, "p", "q", "r", "u")]
    docs = spark.createDataFrame(rows, CLASH)
    assert sorted((r.doc_id, r.text) for r in keep_one_of_each(docs).collect()) == [(1, t), (2, other)]
    assert sorted((r.doc_id, r.text) for r in drop_exact_copies(docs).collect()) == sorted([(2, t), (2, other)])
    assert keep_one_of_each(docs).columns == docs.columns == drop_exact_copies(docs).columns


def test_repeated_rows_spread_over_the_shards(spark):
    docs = spark.createDataFrame([(7, "same words", "s")] * 600 + [(i, f"text {i}", "t") for i in range(100)], "doc_id long, text string, source string")
    sizes = [r["count"] for r in packing.pack(docs, shard_rows=100).groupBy("shard").count().collect()]
    assert sum(sizes) == 700 and max(sizes) < 2 * 700 / len(sizes) and len(sizes) == 7


@pytest.mark.parametrize("stage", ["quality", "exact_dedup", "near_dedup", "substring_dedup"])
def test_stages_take_an_empty_table(spark, stage):
    import corpus_pipeline
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "/root/testdata/sf0.001")
    assert out.count() == 0 and out.columns == corpus_pipeline.COLUMNS


def test_buckets_are_sized_and_paired_without_joins(spark, capsys):
    from foldwise.llm import simjoin

    rnd = random.Random(8)
    rows = sorted({(rnd.randrange(25), i, i % 3) for i in range(150) for _ in range(5)} | {(90, i, 7) for i in range(40)}
                  | {(k, i, i) for k in (91, 92, 93) for i in range(4)})
    by_key = {}
    for k, i, c in rows:
        by_key.setdefault(k, []).append((i, c))
    mixed = {k: m for k, m in by_key.items() if len({c for _, c in m}) > 1}
    live = simjoin._live(spark.createDataFrame(rows, "key long, id long, component long"))
    live.explain()
    assert "Join" not in capsys.readouterr().out
    assert {tuple(r) for r in live.collect()} == {(k, i, c, len(m)) for k, m in mixed.items() for i, c in m} and live.count() == sum(map(len, mixed.values()))
    small = live.where(F.col("size") <= simjoin.SMALL)
    want = {(a, b) for m in mixed.values() if len(m) <= simjoin.SMALL for a, x in m for b, y in m if a < b and x != y}
    assert sorted(map(tuple, simjoin._small_pairs(small).collect())) == sorted(want)
    large = {k: m for k, m in mixed.items() if len(m) > simjoin.SMALL}
    got = {r.id: r for r in simjoin._centred(live.where(F.col("size") > simjoin.SMALL)).collect()}
    assert large and set(got) == {i for m in large.values() for i, _ in m}
    component = {i: c for m in large.values() for i, c in m}
    for i, r in got.items():
        own = [m for m in large.values() if i in dict(m)]
        assert r.c == len(own) and set(r.least) == {min(m)[0] for m in own}
        assert all(component[x] != r.component and any(x in dict(m) for m in own) for x in r.centres) and len(r.centres) <= simjoin.CENTRES * len(own)
        assert {min(m)[0] for m in own if min(m)[1] != r.component} <= set(r.centres)


def test_words_of_odd_bytes_and_texts():
    texts = [b"", b" ", b"a", b"\n\n", b"A B\xff\xc3 c\x0bD", bytes(range(256)) * 2, b"", b"x y"]
    for part in (texts, texts[3:], texts[::-1], [b""], [b" \t"]):
        w = unit_dedup.Words(part)
        plain = [(i, x) for i, t in enumerate(part) for x in t.lower().split()]
        got = [(int(i), w.octets[s:e].tobytes()) for i, s, e in zip(w.text, w.starts, w.ends, strict=True)]
        assert got == plain
        assert list(w.first) == [sum(i < k for i, _ in plain) for k in range(len(part))]
        assert len({*w.hashes.tolist()}) == len({x for _, x in plain})
