"""Periodic runs, suffix-array dedup and fill-in-middle: brute force, round trips and the defined edge cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from foldwise.llm import fill_middle as fim
from foldwise.llm import period_runs as pr
from foldwise.llm import suffix_dedup as sd
from foldwise.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, bit long, text_hash string, runs string, spans string, bucket int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, None, 1, "a", "b", "c", 2), (2, "", None, None, None, None, None), (3, "é 😀 " * 40, 1, "", "", "", 1),
        (4, "One two\nthree", 1, "", "", "", 1), (4, "One two\nthree", 1, "", "", "", 1), (4, "other text of the id " * 9, 1, "", "", "", 1),
        (None, "é 😀 " * 40, 1, "", "", "", 1), (6, LONG, 1, "", "", "", 1), (7, LONG + " tail", 1, "", "", "", 1), (8, "aa" * 3000, 1, "", "", "", 1)]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op12_suffix_dedup", "op13_fill_middle"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


# ---- periodic runs

def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        k = 0
        while k < len(w) - q:
            e = k
            while e < len(w) - q and w[e] == w[e + q]:
                e += 1
            if e > k and e - k + q >= max(24, 3 * q):
                found.setdefault((k, e - k + q), q)
            k = max(e, k + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    """The contract's columns by plain loops."""
    w = [x for x in (text or "").encode().split() if x]
    n, h = len(w), zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_words(rnd):
    w = []
    for _ in range(rnd.randint(0, 5)):
        k, kinds = rnd.choice([1, 2, 3, 5, 8, 13]), rnd.choice([1, 2, 3, 50])
        w += ([rnd.randrange(kinds) for _ in range(k)] * 40)[:rnd.randint(0, 90)]
        w += [rnd.randrange(kinds) for _ in range(rnd.randint(0, 10))]
    return w


def test_runs_equal_brute_force_within_one_sequence():
    rnd = random.Random(3)
    for _ in range(300):
        texts = [random_words(rnd) for _ in range(rnd.randint(1, 8))]
        assert [list(map(tuple, r.tolist())) for r in pr.runs_of(texts)] == [brute_runs(w) for w in texts]
    assert pr.runs_of([]) == []


def test_grid_portions_do_not_change_the_runs(monkeypatch):
    rnd = random.Random(4)
    texts = [random_words(rnd) for _ in range(40)]
    want = [r.tolist() for r in pr.runs_of(texts)]
    monkeypatch.setattr(pr, "GRID", 100)
    assert [r.tolist() for r in pr.runs_of(texts)] == want


def test_grammar_extensions_equal_a_plain_scan():
    rnd = random.Random(5)
    for _ in range(60):
        kinds = rnd.choice([1, 2, 3])
        seq = np.array([rnd.randrange(kinds) for _ in range(rnd.randint(2, 200))] + [-1])
        n = len(seq) - 1
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        i, j = np.array(rnd.sample(pairs, min(200, len(pairs)))).T
        grammar = pr.RunLengthGrammar(seq)
        assert len(grammar.symbols[-1]) <= 2 and len(grammar.symbols) < 120
        for x, y, got in zip(i, j, grammar.extension(i, j), strict=True):
            k = 0
            while max(x, y) + k < n and seq[x + k] == seq[y + k]:
                k += 1
            assert k == got


def test_run_query_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: tuple(r) for r in entry.queries()["op11_period_runs"](spark, SF).collect()}
    want = {i: brute_row(i, t) for i, t in docs.select("doc_id", "text").collect()}
    assert got == want and any(r[1] for r in want.values())


def test_period_runs_edges(odd, empty):
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed.decode()) for r in pr.periodic_runs(odd).collect()]
    assert (1, 0, [], "") in got and (2, 0, [], "") in got and (6, 30_000, [(0, 30_000, 977)], " ".join(LONG.split()[:977])) in got
    assert (None, 80, [(0, 80, 2)], "é 😀") in got and (8, 1, [], "aa" * 3000) in got and len(got) == len(ROWS)
    assert (4, 45, [(0, 45, 5)], "other text of the id") in got
    assert pr.periodic_runs(empty).count() == 0 and pr.run_digests(empty).count() == 0
    # a null id plants as the empty id, whose crc32 is 0: from word 0, period 1 + n // 3
    w = ("é 😀 " * 40).split()
    assert [r.text for r in pr.plant_repeats(odd).where("doc_id is null").collect()] == [" ".join(w[i % 27] for i in range(80))]


# ---- suffix arrays

def brute_cut(rows):
    """{(id, text): (n_removed, n_spans, kept)} with windows seen in ascending order of (id, hash of the text)."""
    seen, out = set(), {}
    for i, raw in rows:
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for k in range(len(raw) - sd.LENGTH + 1):
            w = raw[k:k + sd.LENGTH]
            if w in seen:
                gone[k:k + sd.LENGTH] = True
            seen.add(w)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[i, raw] = (int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]]))
    return out


def in_order(docs):
    from pyspark.sql import functions as F
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).distinct()
    rows = rows.withColumn("h", F.xxhash64(F.col("t").cast("binary"))).orderBy("doc_id", "h")
    return [(r.doc_id, r.t.encode()) for r in rows.collect()]


def random_docs(rnd, n):
    """Shared passages with changes, copies, periodic texts and multibyte characters."""
    pieces = ["".join(rnd.choice("abcdé 😀") for _ in range(rnd.randint(60, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join(rnd.choice([rnd.choice(pieces), "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(1, 150))),
                                rnd.choice(["xyz", "q", "ab c"]) * rnd.randint(1, 120)]) for _ in range(rnd.randint(0, 6)))
        if rnd.random() < 0.3 and t:
            k = rnd.randrange(len(t))
            t = t[:k] + "#" + t[k + 1:]
        rows.append((i * 3, t if rnd.random() < 0.8 or not rows else rows[rnd.randrange(len(rows))][1]))
    return rows


@pytest.mark.parametrize(("most", "bucket", "part"), [(sd.MOST_RUNS, 50, 500), (2, 8192, 1 << 20)])
def test_cut_repeats_equals_brute_force(spark, monkeypatch, most, bucket, part):
    monkeypatch.setattr(sd, "BUCKET_RUNS", bucket)
    docs = spark.createDataFrame(random_docs(random.Random(bucket), 150), "doc_id long, text string")
    text = dict(in_order(docs))
    got = {(r.doc_id, text[r.doc_id]): (sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept))
           for r in sd.cut_repeats(docs, most_runs=most).collect()}
    want = brute_cut(in_order(docs))
    assert got == want and sum(w[0] for w in want.values()) > 1000


def test_runs_hold_every_window_once_and_parts_do_not_lose_any(monkeypatch):
    texts = [t.encode() for _, t in random_docs(random.Random(1), 60)]

    def windows():
        text, at, count, gram, digest = sd.text_runs(texts)
        assert len(set(zip(gram, digest, strict=True))) == len({(texts[t][a:a + c + 99]) for t, a, c in zip(text, at, count, strict=True)})
        # equal windows have equal grams
        named = {}
        for t, a, c, g in zip(text.tolist(), at.tolist(), count.tolist(), gram.tolist(), strict=True):
            for k in range(a, a + c):
                assert named.setdefault(texts[t][k:k + 100], g) == g
        return [(t, k) for t, a, c in zip(text.tolist(), at.tolist(), count.tolist(), strict=True) for k in range(a, a + c)]

    want = [(t, k) for t, x in enumerate(texts) for k in range(len(x) - 99)]
    assert windows() == want
    monkeypatch.setattr(sd, "PART", 700)
    assert windows() == want


def test_family_levels_grow_geometrically(monkeypatch):
    rnd = random.Random(2)
    base = bytes(rnd.randrange(256) for _ in range(3000))
    raws = []
    for _ in range(1000):
        a, n = rnd.randrange(2800), rnd.randint(100, 170)
        x = bytearray(base[a:a + n] if rnd.random() < 0.7 else bytes(rnd.randrange(256) for _ in range(n)))
        x[rnd.randrange(len(x))] = rnd.choice([0, 0, 255])
        raws.append(bytes(x.ljust(100, b"\0")))
    family, seen = sd.SuffixFamily(), set()
    for lo in range(0, 1000, 50):
        batch = raws[lo:lo + 50]
        places, windows = [], []
        for k, x in enumerate(batch):
            for i in range(len(x) - 99):
                places.append(sum(map(len, batch[:k])) + i)
                windows.append(x[i:i + 100])
        got = family.add(np.frombuffer(b"".join(batch), np.uint8), np.array(places)).tolist()
        want = []
        for w in windows:
            want.append(w in seen)
            seen.add(w)
        assert got == want
    sizes = [n for n, _ in family.levels]
    assert sizes == sorted(set(sizes), reverse=True) and sum(sizes) == 20
    held = [family._bytes_at(level) for _, level in family.levels]
    assert all((h[1:] > h[:-1]).all() for h in held) and sum(map(len, held)) == len(seen)


def test_cut_repeats_edges(odd, empty):
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in sd.cut_repeats(odd).collect()]
    assert len(got) == len(ROWS) and (1, 0, [], b"") in got and (2, 0, [], b"") in got
    null = ("é 😀 " * 40).encode()
    assert (None, len(null), [], null) in got  # left alone, and not a copy of document 3 for anyone
    assert (8, 6000, [(1, 6000)], b"a") in got or (8, 6000, [(2, 6000)], b"aa") in got
    want = brute_cut(in_order(odd))
    assert {(i, k) for i, _, _, k in got if i is not None} == {(i, k) for (i, _), (_, _, k) in want.items()}
    assert sum(1 for g in got if g[0] == 4) == 3
    assert sd.cut_repeats(empty).count() == 0 and sd.cut_digests(empty).count() == 0


# ---- fill in the middle

def brute_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def test_index_converts_both_ways():
    rnd = random.Random(1)
    for _ in range(500):
        t = "".join(rnd.choice("ab é€😀<PSM>") for _ in range(rnd.randint(0, 30)))
        raw = t.encode()
        index = fim.ExceptionIndex(raw)
        assert index.n_chars == len(t) and len(index.char_at) == sum(not c.isascii() for c in t)
        assert index.to_byte(np.arange(len(t) + 1)).tolist() == [len(t[:i].encode()) for i in range(len(t) + 1)]
        assert index.to_char(np.arange(len(raw) + 1)).tolist() == [i for i, c in enumerate(t) for _ in c.encode()] + [len(t)]
        draws = [rnd.randrange(2**32) for _ in range(4)]
        for unit in ("chars", "bytes"):
            n, form, a, m, out = fim.transform(raw, draws, unit=unit)
            assert n == (len(t) if unit == "chars" else len(raw)) and fim.restore(out, form) == raw
            assert len(out.decode()) in (len(t), len(t) + 9)  # no character is ever cut in two
    broken = b"\x80\xbfab\xff\xc3"
    assert fim.restore(fim.transform(broken, [5, 1, 0, 0])[4], "spm") == broken


def test_fill_in_middle_edges(odd, empty):
    got = [tuple(r) for r in fim.restored(fim.fill_in_middle(odd)).collect()]
    want = [(i, *(w := brute_fim(i, t))[:4], w[4].encode(), (t or "").encode()) for i, t, *_ in ROWS]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert fim.fill_in_middle(empty).count() == 0 and fim.fill_digests(empty).count() == 0
    assert {r.form for r in fim.fill_in_middle(odd, fim_percent=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(odd, fim_percent=100, spm_percent=100, unit="bytes").collect()} == {"plain", "spm"}
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(odd, unit="words")


def test_markers_across_a_cut_restore(spark):
    texts = ["<", "<P", "P><S", "<<S>x", "a<M", ">" * 9, "<M>", "S><", "<S<P<M"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 12)], "doc_id long, text string")
    for r in fim.fill_digests(docs).collect():
        t = texts[r.doc_id % len(texts)]
        assert r.restored_sha256 == sha(t) and r.output_sha256 == sha(brute_fim(r.doc_id, t)[4])
