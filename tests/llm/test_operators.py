"""Operators on small inputs: brute force, round trips and the defined edge cases."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foldwise.llm import bpe, common, packing, paragraph_dedup, pitman_yor, quality_fm, sharding, simjoin, unit_dedup, url_filter, winnow
from foldwise.llm.exact_dedup import drop_exact_copies, exact_groups
from foldwise.llm.near_dedup import keep_one_of_each, near_groups

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, v string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, None, "en", None, None, "x", "y"), (2, "", None, "s", 0, None, None), (3, "One two\nthree", "en", "s", 13, "", ""),
        (4, "one TWO\nthree", "en", "s", 13, "", ""), (4, "one TWO\nthree", "en", "s", 13, "", ""), (None, "null id", "en", "s", 7, "", ""),
        (6, LONG, "en", "s", len(LONG), "", ""), (7, LONG + " tail", "en", "s", len(LONG) + 5, "", ""), (8, "É é", "fr", "t", 3, "", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else set(zip(*(w[i:] for i in range(5)), strict=False))


def brute_components(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op8_near_dedup", "paragraph_lines"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_exact_groups_edges(odd, empty):
    got = {(r.doc_id, r.text_sha256): r for r in exact_groups(odd).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1, sha("")].keep_id == 2 and not got[1, sha("")].kept and got[2, sha("")].group_size == 2
    assert got[3, sha("one two\nthree")].keep_id == 4 and got[3, sha("one two\nthree")].group_size == 3
    assert got[None, sha("null id")].kept and got[8, sha("É é")].kept
    assert exact_groups(odd).count() == len(ROWS) and exact_groups(empty).count() == 0
    assert sorted(r.doc_id or 0 for r in drop_exact_copies(odd).collect()) == [0, 2, 4, 4, 6, 7, 8]


def test_near_groups_edges(odd, empty):
    got = {r.doc_id: r for r in near_groups(odd).collect()}
    assert got[1].n_shingles == 0 and got[1].component_id == 1 and got[2].component_id == 2
    assert got[4].component_id == 3 and got[7].component_id == 6 and got[None].component_id is None and got[None].kept
    assert near_groups(empty).count() == 0 and near_groups(odd).count() == len(ROWS)
    assert {r.doc_id for r in keep_one_of_each(odd).collect()} == {None, 1, 2, 3, 6, 8}


@pytest.mark.parametrize("small", [2, 24])
def test_near_groups_equal_brute_force_in_crowded_buckets(spark, monkeypatch, small):
    monkeypatch.setattr(simjoin, "SMALL", small)
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(90):
        w = passage + [f"d{i}x{j}" for j in range(rnd.choice([4, 8, 30]))]
        for _ in range(rnd.choice([0, 1, 3])):
            w[rnd.randrange(len(w))] = f"e{rnd.random()}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components({k: shingles(t) for k, t in rows})


def test_paragraphs_are_removed_once(spark, odd, empty):
    p = " ".join(f"a{i}" for i in range(60))
    q = p.replace("a30", "changed")
    rows = [(5, f"own one\n{p}\nrest", "en", "s", 9), (6, f"{q}\nother", "en", "s", 9), (7, "clean text", "en", "s", 10),
            (8, f"x\n{p.upper()}", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.line, r.start, r.keep_doc_id, r.keep_line, r.cluster_size)
                 for r in paragraph_dedup.repeated_paragraphs(docs).collect())
    assert got == [(6, 0, 0, 5, 1, 3), (8, 1, 2, 5, 1, 3)]
    cut = {r.doc_id: (r.text, r.n_chars) for r in paragraph_dedup.without_repeats(docs).collect()}
    assert cut == {5: (rows[0][1], 9), 6: ("other", 5), 7: ("clean text", 10), 8: ("x", 1)}
    assert paragraph_dedup.repeated_paragraphs(empty).count() == 0
    assert paragraph_dedup.without_repeats(odd).count() == len(ROWS)


def runs(text, n=paragraph_dedup.PASSAGE_WORDS):
    w = text.lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_passages_of_any_layout_are_cut_once(spark):
    rnd = random.Random(9)
    own = lambda n: [f"o{rnd.random()}" for _ in range(n)]
    passages = [[f"é{k}x{i}" for i in range(rnd.randint(50, 90))] for k in range(4)]
    rows = []
    for i in range(40):
        w = own(rnd.randint(60, 150)) + rnd.choice(passages) + own(rnd.randint(60, 150))
        per = rnd.choice([7, 13, 10_000])  # wrapped into short lines, or inside one long line
        rows.append((i, "\n".join(" ".join(w[j:j + per]) for j in range(0, len(w), per)), len(" ".join(w))))
    rows.append((0, *rows[0][1:]))  # a repeated row is the same document
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    left = paragraph_dedup.without_repeats(docs).collect()
    seen = collections.Counter(r for _, t in {(x.doc_id, x.text) for x in left} for r in runs(t))
    assert max(collections.Counter(r for _, t in set((i, t) for i, t, _ in rows) for r in runs(t)).values()) > 1
    assert max(seen.values()) == 1 and len(left) == len(rows)
    words = lambda texts: {w for t in texts for w in t.split()}
    assert words(x.text for x in left) == words(t for _, t, _ in rows)  # no word is lost everywhere
    assert all(x.n_chars == len(x.text) for x in left)
    text = {i: t for i, t, _ in rows}
    for x in paragraph_dedup.repeated_passages(docs).collect():
        span = text[x.doc_id][x.start:x.start + x.n_chars].split()
        assert span == text[x.doc_id].split()[x.word:x.word + x.n_words]
        assert span[:paragraph_dedup.GRAM] == text[x.keep_doc_id].split()[x.keep_word:][:paragraph_dedup.GRAM]


def test_tuned_bands_reach_the_recall():
    bands, rows = paragraph_dedup.tune_bands(0.75, 1e-3)
    assert rows >= 2 and (1 - 0.75**rows) ** bands <= 1e-3 < (1 - 0.75**rows) ** (bands - 1)


def test_bpe_equals_the_library_and_round_trips(spark, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.BpeCodec(path)
    rnd = random.Random(3)
    texts = ["", "a", "  two  spaces\n\n", "<|endoftext|>x<|endoftext|>", "don't 漢字🙂 \x85\xa0½²", "x" * 5000]
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 0x24F), rnd.randint(0x250, 0xD7FF)])) for _ in range(30)) for _ in range(200)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = bpe.encode_documents(odd, path).collect()
    assert len(got) == len(ROWS) and {r.decoded for r in got} == {r[1] or "" for r in ROWS}
    assert bpe.encode_digests(empty, path).count() == 0


def test_winnowing_keeps_every_long_shared_passage():
    rnd = random.Random(1)
    text = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    for _ in range(50):
        shared = text(winnow.K + winnow.WINDOW - 1)
        marks = [winnow.winnow(np.array([ord(c) for c in text(90) + shared + text(90)]))[0] for _ in range(2)]
        assert set(marks[0]) & set(marks[1])


def test_winnowing_rightmost_minimum_per_window():
    codes = np.array([ord(c) for c in "abab" * 40 + "xyz"])
    h = winnow.rolling_hashes(codes, 3)
    want = sorted({max(i for i in range(s, s + 8) if h[i] == h[s:s + 8].min()) for s in range(len(h) - 7)})
    assert winnow.winnow(codes, 3, 8)[1].tolist() == want


def test_neighbours_follow_the_ids(spark, empty):
    rows = [(i * 3, f"text number {i} " * (i % 4 + 1)) for i in range(40)] + [(999, None)]
    got = {r.doc_id: r for r in winnow.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), blocks=5).collect()}
    assert len(got) == 41
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = winnow.edited_text(t or "", nxt or "")
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert winnow.neighbour_fingerprints(empty).count() == 0


def test_url_rules_and_models(spark):
    urls = [f"https://good{i % 9}.example.net/en/{i}" for i in range(300)] + [f"http://spam-{i}.host.net/x/{i}" for i in range(300)]
    urls += ["HTTP://A.example.COM/de/x", "https://blog.some.org/fr/1", None, "no scheme", "", "https://x.org", "http://org/fr/"]
    rows = [(i, u, "extra") for i, u in enumerate(urls)] + [(600, urls[600], "extra")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert (got[0].rule, got[0].verdict) == ("example.net/en/", "allow") and (got[300].rule, got[300].verdict) == ("net/", "block")
    assert (got[600].host, got[600].rule, got[600].verdict) == ("a.example.com", "example.com/de/", "block")
    assert got[601].rule == "org/fr/" and got[602].host == "" and got[603].rule is None and got[606].rule == "org/fr/"
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_character_model_sums_to_one():
    counts = collections.Counter(c for t in (b"abcab", b"abd") for c in url_filter.gram_cells(t, 2, 64))
    m = url_filter.CharModel(counts, 2, 64)
    ends = sum(np.exp(m.log_likelihood(b"a" + bytes([s])) - m.log_likelihood(b"a")) for s in range(256))
    assert np.isfinite(ends)


def test_machine_equals_all_pairs():
    m = quality_fm.FactorisationMachine(size=40, rank=3)
    m.w[:] = np.linspace(-1, 1, 40)
    idx, val = np.array([1, 5, 9, 30]), np.array([0.5, 1.0, -2.0, 0.25])
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * val[i] * val[j] for i in range(4) for j in range(i))
    assert abs(m.raw_score(idx, val) - (m.bias + m.w[idx] @ val + pairs)) < 1e-12


def test_quality_on_held_out_documents(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = entry.queries()["op7_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert docs.count() > len(got)
    none = labels.where("false")
    assert {r.score for r in quality_fm.score_quality(odd, quality_fm.fit_quality(odd, none)).collect()} == {0.5}
    assert quality_fm.keep_good(empty, labels).count() == 0


def test_shards_are_even_and_groups_whole(spark, odd, empty):
    rows = [(i, f"group {i % 7}" if i < 60 else f"single {i}") for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert {len(s) for s in by.values()} == {25} and all(sorted(s) == list(range(25)) for s in by.values())
    text = dict(rows)
    assert all(len({r.shard for r in got if text[r.doc_id] == f"group {g}"}) == 1 for g in range(7))
    assert sharding.shard_documents(odd).count() == len(ROWS) and sharding.shard_documents(empty).count() == 0


def test_packing_equals_the_plain_search():
    rnd = random.Random(2)
    pieces = sorted(((rnd.randint(1, 40), rnd.choice("abcd" + "a" * 4), rnd.choice([None, 1, 2, rnd.random()])) for _ in range(400)),
                    key=lambda p: -p[0])
    got = packing.pack_shard(*map(list, zip(*pieces, strict=True)), 50)
    room, sources, clusters = [], [], []
    for (size, s, c), b in zip(pieces, got, strict=True):
        fits = [i for i in range(len(room)) if room[i] >= size and s not in sources[i] and (c is None or c not in clusters[i])]
        best = min((room[i] for i in fits), default=None)
        if best is None:
            assert b == len(room)
            room.append(50)
            sources.append(set())
            clusters.append(set())
        else:
            assert room[b] == best and b in fits
        room[b] -= size
        sources[b].add(s)
        clusters[b].add(c)


def test_pack_covers_every_token(odd, empty):
    got = packing.pack(odd, capacity=100).toPandas()
    assert got.groupby(["shard", "bin"]).n_tokens.sum().max() <= 100
    assert got.n_tokens.sum() == sum(len((r[1] or "").split()) + 1 for r in ROWS)
    assert packing.pack(empty).count() == 0


def test_pitman_yor_beats_the_base_and_takes_odd_rows(spark, odd, empty):
    rows = [(i, " ".join(random.Random(i).choices("abcdefg", k=40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pitman_yor.score_documents(docs, frequent=4).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 60 and held and sum(r.score for r in held) > sum(r.base_score for r in held) * 1.2
    assert pitman_yor.score_documents(odd).count() == len(ROWS) and pitman_yor.score_documents(empty).count() == 0


def test_pitman_yor_rare_words_have_contexts_of_their_own(spark, monkeypatch):
    # k words, all with the last byte "z", each with one successor; the words between are the most frequent
    rnd = random.Random(3)
    rows = [(i, " ".join(f"x {k}z y{k}" for k in rnd.choices(range(30), k=25))) for i in range(80)] + [(90, "new 3z y3 8z"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 300)
    few = {r.doc_id: r for r in pitman_yor.score_documents(docs, frequent=1).collect()}
    all_ = {r.doc_id: r for r in pitman_yor.score_documents(docs, frequent=1000).collect()}
    assert len(few) == len(all_) == 82
    for i, r in few.items():
        assert abs(r.score - all_[i].score) < 0.02 * abs(all_[i].score) + 0.1
        assert (r.n_known, r.n_tokens, r.base_score) == pytest.approx((all_[i].n_known, all_[i].n_tokens, all_[i].base_score))


def test_bucket_model_is_a_distribution():
    rng = np.random.default_rng(0)
    cells = pitman_yor.pack(np.arange(5, dtype=np.uint64), np.full(5, 3, "<u2"), np.tile(np.arange(3), 5).astype("<u2"),
                            rng.integers(1, 300, 15).astype("<i8"))
    _, _, ctx, count = pitman_yor.unpack(cells)
    customers = np.bincount(ctx, weights=count)
    t, c0, t0 = pitman_yor.sample(cells, np.full(3, 5.0), 15.0, 5.0, 6.0, 1, 2, 3)
    totals = pitman_yor.Totals(int(count.sum()), 5, customers, np.bincount(ctx, weights=t.astype("<f4")), c0.sum(), t0.sum())
    m = pitman_yor.BucketModel(cells + pitman_yor.pack(t.astype("<f4"), c0, t0), totals)
    words = np.arange(6, dtype=np.uint64)  # the last one is unknown
    for u in range(3):
        _, _, lp = m.look_up(words, np.arange(6), np.full(6, u))
        assert abs((10**lp).sum() - 1) < 1e-6


def test_components_of_long_chains(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(60)] + [(200, 201), (203, 201)]
    rnd.shuffle(chain)
    got = dict(common.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and got[203] == 200


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        after = common.written(stage(spark, docs, SF), name)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        if name == "exact_dedup":
            texts = [r.text.encode().lower() for r in after.collect()]
            assert len(texts) == len(set(texts))
        if name == "near_dedup":
            sets = {r.doc_id: shingles(r.text) for r in after.collect()}
            assert brute_components({k: s for k, s in sets.items() if s}) == {k: k for k, s in sets.items() if s}
        docs = after
    assert cp.STAGES[-1][1](spark, docs, SF).select(F.countDistinct("doc_id")).first()[0] == docs.count()


def test_written_tables_leave_no_shuffle_files(spark):
    import glob
    import os
    import tempfile
    import time

    def files():
        top = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
        return {f for f in glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data") if os.stat(f).st_mtime >= start}

    start = time.time() - 1
    rows = spark.range(0, 50_000, 1, 6).groupBy((F.col("id") % 997).alias("k")).count().repartition(3, "count")
    got = common.written(rows, "no-shuffle-files")
    for _ in range(20):
        left = files()
        if not left:
            break
        time.sleep(0.5)
    assert not left and got.count() == 997


def tables_on_disk(spark):
    import os

    from foldwise.session import shared_dir

    return {d for d in os.listdir(shared_dir(spark)) if d.startswith("llm-")}


def test_operators_delete_the_tables_of_their_steps(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(simjoin, "SMALL", 2)  # all steps of the joins take part
    for run, kept in ((near_groups, {"judged"}), (unit_dedup.repeated_units, {"occurrences", "kept-units"}),
                      (unit_dedup.without_repeated_units, {"unit-spans"}), (pitman_yor.score_documents, {"py-scores"})):
        before = tables_on_disk(spark)
        got = run(docs)
        assert {d[4:].rsplit("-", 1)[0] for d in tables_on_disk(spark) - before} == kept
        assert got.count() > 0


def test_a_scratch_keeps_what_is_asked_for_and_loses_nothing_on_errors(spark):
    before = tables_on_disk(spark)
    with common.scratch():
        with common.scratch():
            a = common.written(spark.range(5), "a")
            b = common.written(a.union(a), "b", keep=True)
        assert {d[:6] for d in tables_on_disk(spark) - before} == {"llm-b-"} and b.count() == 10
    assert tables_on_disk(spark) == before
    with pytest.raises(ValueError), common.scratch():
        common.written(spark.range(5), "c")
        raise ValueError
    c = common.written(spark.range(7), "d")
    assert c.count() == 7 and {d[:6] for d in tables_on_disk(spark) - before} == {"llm-c-", "llm-d-"}
