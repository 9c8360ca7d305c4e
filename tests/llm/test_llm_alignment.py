"""Token alignment, decontamination and whitening over small messy tables, against plain Python, SQL and numpy."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from spindlestat.llm import alignment, queries, whitening, winnowing
from spindlestat.llm.bpe import byte_signs

RNG = random.Random(17)
WORDS = ["".join(RNG.choice("abdegiklmnoprstuv") for _ in range(RNG.randrange(2, 8))) for _ in range(120)]
DOCUMENTS = "doc_id long, text string, row long, n int, pair string, window string, item string, class int, x double, component int"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 9, 9, "p", "w", "i", 9, 0.5, 9) for i, t in texts], DOCUMENTS).repartition(3)


# Alignment

MESSY = [
    (1, "plain words, and (more) words"), (2, "plain words, and (more) words"), (3, None), (4, ""), (5, " "), (6, "  two  spaces \t tab\n\nlines "), (7, "▁piece sign"), (8, "<|endoftext|> <s> </s> <0x41> <unk>"),
    (9, "Übergröße naïve \U0001f600\U0001f468‍\U0001f469 中文 ́x ᲉꟋ"), (10, "x" * 5000), (11, "a\x00b \x1c c\x85d e"), (None, "no id"), (12, "twice"), (12, "twice"), (13, "don't we'll 12345 ½ #!?"), (14, prose(4000)), (15, "é" * 700 + " 1 2 3"),
]


@pytest.fixture(scope="module")
def tokenizers():
    public = pytest.importorskip("public_tokenizers")
    sentencepiece, library = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
    pytest.importorskip("tiktoken")
    paths = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
    a = library.Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    return paths, a, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def plain_alignment(texts, a, b):
    """Links and groups by walking over byte ranges."""
    signs, names = byte_signs(), {i: t for t, i in a.get_vocab().items()}
    bytes_a = lambda i: bytes(signs[c] for c in names[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, of):
        ends = np.cumsum([len(of(i)) for i in ids]).tolist()
        return list(zip([0, *ends], ends, ids, strict=False))

    rows, seen = [], collections.Counter()
    for i, t in texts:
        t = t or ""
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if b"".join(map(bytes_a, x)) != (" " + t).encode() or b"".join(map(bytes_b, y)) != (" " + t).encode():
            x, y = [], []
        x, y = spans(x, bytes_a), spans(y, bytes_b)
        links, k = [], 0
        for start, end, p in x:
            while k < len(y) and y[k][1] <= start:
                k += 1
            j = k
            while j < len(y) and y[j][0] < end:
                links.append((p, y[j][2]))
                j += 1
        groups, last = [], 0
        for cut in sorted({e for _, e, _ in x} & {e for _, e, _ in y}):
            groups.append("|".join(",".join(str(p) for s, e, p in side if s >= last and e <= cut) for side in (x, y)))
            last = cut
        rows.append((i, len(x), len(y), len(groups), links, ";".join(groups)))
        seen.update(set(links))
    best = collections.Counter()
    for (p, _), n in seen.items():
        best[p] = max(best[p], n)
    return [(i, na, nb, ng, len(links), sum(seen[x] == best[x[0]] for x in links), sum(seen[x] for x in links), g) for i, na, nb, ng, links, g in rows]


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 40, 1])
def test_alignment_of_messy_texts(spark, tokenizers, most_pairs):
    """Whether pairs are looked up in arrays, or joined, or some this way and some that."""
    paths, a, b = tokenizers
    want = collections.Counter(plain_alignment(MESSY, a, b))
    got = alignment.aligned(documents(spark, MESSY), *paths, most_pairs=most_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert collections.Counter(map(tuple, got.collect())) == want
    assert {r[0] for r in want if not r[1]} == {3, 4, 7}


def test_alignment_query(spark, tokenizers, tmp_path):
    _, a, b = tokenizers
    documents(spark, MESSY).write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain_alignment(MESSY, a, b))
    assert collections.Counter(map(tuple, queries.op11_token_alignment(spark, str(tmp_path)).collect())) == want
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_token_alignment(spark, f"{tmp_path}/none").count() == 0


def test_parts_are_forgotten_and_learnt_anew(tokenizers, monkeypatch):
    paths, a, b = tokenizers
    monkeypatch.setattr(alignment, "MOST_PARTS", 3)
    with open(paths[0]) as f, open(paths[1], "rb") as g:
        pair = alignment.Pair(f.read(), g.read())
    texts = [t for _, t in MESSY if t]
    for _ in range(2):
        for t in texts:
            found = alignment.Batch(pair, [t])
            if "▁" not in t:
                assert (found.ids_a.tolist(), found.ids_b.tolist()) == (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t))


def test_pair_counts_bound_what_is_shipped(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([1, 2],), ([1],), ([4, 5, 1],)], "pairs array<long>")
    counted = alignment.pair_counts(rows, 3)
    assert sorted(map(tuple, counted.collect())) == [(1, 4, True), (2, 2, False), (3, 1, True), (4, 1, True), (5, 1, True)]
    for most in range(1, 7):
        least = alignment._least_count(counted, most)
        assert counted.filter(f"n >= {least}").count() == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5}[most]


# Decontamination

PASSAGES = [prose(14) for _ in range(6)]
ITEMS = [(10, PASSAGES[0]), (9, PASSAGES[1].upper() + " -- and more"), (100, PASSAGES[0] + " " + PASSAGES[2]), (11, "Short one here"), (12, "zyx"), (13, prose(7)), (14, None), (15, ""), (16, "..."), (17, prose(9)), (None, PASSAGES[3]), (18, PASSAGES[4]), (18, PASSAGES[5]), (19, "É" * 3 + " été " + prose(8)), (20, "spam " * 30), (21, "one two three four five"), (22, "Ⓐ bb")]
RINGS = [
    (1, "before " + PASSAGES[0].title() + " after"), (2, " ".join(PASSAGES[0].split()[:9])), (3, " ".join(PASSAGES[0].split()[2:12])), (4, PASSAGES[1] + ", and.MORE;" + PASSAGES[2]), (5, None), (6, ""), (7, "?!"), (8, "a short ONE here, zyx short one"), (None, PASSAGES[3]), (9, PASSAGES[4] + PASSAGES[5]), (9, PASSAGES[5]),
    (10, prose(3000) + " " + PASSAGES[5] + " " + prose(50)), (11, ITEMS[5][1] + " x " + ITEMS[9][1]), (12, "ééé été " + ITEMS[13][1][8:]), (13, ITEMS[13][1]), (14, "spam " * 200), (15, "spam " * 9), (16, "One two three four five " * 3), (17, "ⓐ bb"), (18, "Ⓐ BB"), (19, prose(300)),
]
RINGS += [(30 + k, f"{prose(8)} {PASSAGES[0]}") for k in range(40)]


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_overlaps(texts, items, length=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(length, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in texts:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        spans = tuple((k, next(e for e in range(k, len(w) + 1) if e not in hit)) for k in sorted(hit) if k - 1 not in hit)
        out.append((i, len(w), len(hit), len(found), spans, tuple(sorted(found))))
    return out


def items_table(spark, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, n int")


@pytest.mark.parametrize("length", [10, 4, 1])
def test_overlaps_of_messy_texts(spark, length):
    got = winnowing.overlaps(documents(spark, RINGS), items_table(spark, ITEMS), length)
    found = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in got.collect())
    assert found == collections.Counter(plain_overlaps(RINGS, ITEMS, length))


def test_shuffled_joins_find_the_same(spark, monkeypatch):
    from spindlestat.llm import common, components

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    got = winnowing.overlaps(documents(spark, RINGS), items_table(spark, ITEMS))
    found = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in got.collect())
    assert found == collections.Counter(plain_overlaps(RINGS, ITEMS))


def test_decontamination_query_and_its_sql(spark, tmp_path):
    import duckdb

    documents(spark, RINGS).write.parquet(f"{tmp_path}/documents.parquet")
    items_table(spark, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    sha = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
    want = collections.Counter((i, n, hit, m, sha(names), hit > 0) for i, n, hit, m, _, names in plain_overlaps(RINGS, ITEMS))
    got = queries.op12_decontamination(spark, str(tmp_path))
    assert collections.Counter(map(tuple, got.collect())) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.sql(queries.ORACLE_SQL["op12_decontamination"])
    assert found.columns == got.columns and collections.Counter(found.fetchall()) == want


def test_decontamination_of_empty_tables(spark):
    assert winnowing.overlaps(documents(spark, []), items_table(spark, ITEMS)).count() == 0
    got = winnowing.overlaps(documents(spark, RINGS[:8]), items_table(spark, [])).collect()
    assert len(got) == 8 and all(r.n_hit == r.n_items == 0 and r.spans == r["items"] == [] for r in got)


def test_decontamination_is_native(spark):
    plan = winnowing.overlaps(documents(spark, RINGS), items_table(spark, ITEMS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


# Whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<double>, component int, x double, part int").repartition(3)


def plain_whitening(rows, top=4):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in kept])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    return kept, n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ v / np.sqrt(e), e / (c**2).sum() * n


def test_whitening_of_messy_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 9)) @ np.diag([9, 5, 3, 2, 1, 0.7, 0.5, 0.3, 0.1])
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(k, base[0].tolist()) for k in range(900, 1200)] + [(None, base[1].tolist()), (5, base[2].tolist())]
    bad = [(2000, None), (2001, []), (2002, [None] * 9), (2003, [math.nan] * 9), (2004, [math.inf] + [0.0] * 8), (2005, [1.0, 2.0])]
    out = whitening.whitened(vectors(spark, rows + bad)).toPandas()
    kept, n, deviation, white, explained = plain_whitening(rows)
    assert len(out) == 4 * len(kept) and set(out.n) == {n} and set(out.identity_error) == {out.identity_error[0]} and out.identity_error[0] < 1e-9
    assert np.allclose(out.groupby("component").explained.first(), explained, rtol=1e-9, atol=0)
    one = out[out.vec_id.between(0, 4)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign(one[0] / white[0])
    assert np.allclose(one, white[:5] * sign, atol=1e-8)
    copies = out[out.vec_id.between(900, 1199)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(copies, white[0] * sign, atol=1e-8)
    by_id = dict(zip([i for i, _ in kept], deviation.tolist(), strict=True))
    assert all(by_id[r.vec_id] == r.deviation for r in out.itertuples() if r.vec_id == r.vec_id and r.vec_id != 5)
    assert out[out.vec_id.isna()].shape[0] == 4


def test_whitening_without_enough_variance(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None), (2, [math.nan])])).count() == 0
    one = whitening.whitened(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    line = whitening.whitened(vectors(spark, [(i, [i / 4, i / 2, 7.0]) for i in range(50)])).collect()
    assert len(line) == 150 and all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-12
    assert {r.component: round(r.explained, 12) for r in line} == {1: 1, 2: 0, 3: 0}


def test_deviations_beyond_a_long_are_null():
    x = np.array([[3, -4], [1 << 40, 0]])
    n, sums = 1 << 24, [5, 6]
    exact = [(n * 3 - 5) ** 2 + (-4 * n - 6) ** 2, (n * (1 << 40) - 5) ** 2 + 36]
    assert whitening.deviations(x, n, sums) == [exact[0], None]
    assert whitening.centred(x, n, sums)[1].tolist() == [float(n * (1 << 40) - 5) / n, -6 / n]


@pytest.mark.parametrize("d", [1, 2, 5, 24])
def test_jacobi_against_svd(d):
    rng = np.random.default_rng(d)
    r = np.triu(rng.normal(size=(d, d))) @ np.diag(10.0 ** -np.arange(d))
    v, sigma = whitening.jacobi(r)
    assert np.allclose(sigma, np.linalg.svd(r)[1], rtol=1e-10, atol=1e-25) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    assert np.allclose(r @ v / sigma, np.linalg.qr(r @ v / sigma)[0] * np.sign(np.diag(np.linalg.qr(r @ v / sigma)[1])), atol=1e-6)


def test_triangles_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(8)
    x = rng.integers(-500, 500, size=(400, 6))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(7)
    r = whitening.joined(whitening.triangles(rows, 400, x.sum(axis=0).tolist()), 6)
    c = x - x.mean(axis=0)
    assert r.shape == (6, 6) and np.allclose(r.T @ r, c.T @ c)
    assert whitening.column_sums(rows) == x.sum(axis=0).tolist()
