"""Alignment, spelling variants and coded ids against brute force, with nulls, empty, long and repeated rows, clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docqa.llm import alignment, huffman, spelling
from docqa.llm.common import table
from docqa.workspace import arrow_bytes, new_folder, settle

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "a", " a", "a ", "a  b \n c", "x " * 60_000, "İß 日本語 \x1c   y\x00z", "▁x y", "a <|endoftext|> b<s></s>", "<|startoftext|>", "é" * 300 + " é́ ﬁ 😀😀",
    "don't I'll we've 123 4,567", "a b c d e f", "a b c d e f", "tab\tand\r\nline\x85end　wide   nb", "ÀÉÎ×÷ àéî" * 40, "Σ ΑΣ ΑΣ. " * 5,
]
SCHEMA = "doc_id long, text string, chunk int, links string, word string, n string, key string, ids int, start int, row int, unit int, size int, part int"
CLASH = (1, "x", "y", "z", "k", 2, 3, 4, 5, 6, 7)


@pytest.fixture(scope="module")
def texts(spark):
    given = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    own = [(10_000 + i, t) for i, t in enumerate(ODD)]
    return given + own + [own[4], own[4], (None, "null id words here"), (None, None), (10_004, "another text of one id")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*t, *CLASH) for t in texts], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


# --- alignment ---


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.vocabularies())


def plain_alignment(pair, text):
    """Groups and links of one whole text, by walking over the ends of all tokens."""
    if not text:
        return [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.a_bytes[i] for i in a) != (" " + text).encode() or b"".join(pair.b_bytes[i] for i in b) != (" " + text).encode():
        return [], []
    spans = [[], []]
    for side, (ids, raw) in enumerate(((a, pair.a_bytes), (b, pair.b_bytes))):
        at = 0
        for i in ids:
            spans[side].append((at, at + len(raw[i]), i))
            at += len(raw[i])
    common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, links, low, k = [], [], 0, [0, 0]
    for high in common:
        own = [[], []]
        for side in (0, 1):
            while k[side] < len(spans[side]) and spans[side][k[side]][1] <= high:
                own[side].append(spans[side][k[side]])
                k[side] += 1
        groups.append((tuple(x[2] for x in own[0]), tuple(x[2] for x in own[1])))
        links += [(x[2], y[2]) for x in own[0] for y in own[1] if x[0] < y[1] and y[0] < x[1]]
        low = high
    return groups, links


def test_alignment(docs, none, texts, pair):
    made = [(d, *plain_alignment(pair, t)) for d, t in texts]
    count = Counter(x for _, _, links in made for x in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    string = lambda g: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
    want = []
    for d, groups, links in made:
        digest = hashlib.sha256(string(groups).encode()).hexdigest() if groups else ""
        n = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        want.append((d, *n, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest))
    got = alignment.summarise(docs)
    same(got, want)
    assert sum(w[1] == 0 for w in want) < 12 and any(len(a) > 1 and len(b) > 1 for _, g, _ in made for a, b in g)
    full = alignment.align(docs)
    same(full.select("doc_id", "n_a", "n_b", "n_groups", "groups"), [(*w[:4], string(g)) for w, (_, g, _) in zip(want, made)])
    same(full.selectExpr("doc_id", "transform(links, x -> concat(x >> 32, ':', x & 4294967295))"), [(d, [f"{a}:{b}" for a, b in links]) for d, _, links in made])
    assert alignment.summarise(none).count() == 0 and alignment.align(none).count() == 0


def test_alignment_of_small_chunks_is_the_same(docs, monkeypatch):
    want = sorted(map(str, alignment.summarise(docs).collect()))
    monkeypatch.setattr(alignment, "CHUNK", 5_000)
    assert sorted(map(str, alignment.summarise(docs).collect())) == want


def test_coalescing_equals_common_ends():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ends = [np.unique(np.append(rng.integers(1, 40, rng.integers(0, 30)), 40)) for _ in (0, 1)]
        a, b = (np.diff(np.concatenate([[0], e])) for e in ends)
        ga, gb, la, lb = alignment.coalesce(a, b)
        common = np.intersect1d(*ends)
        assert (ga == np.searchsorted(common, ends[0])).all() and (gb == np.searchsorted(common, ends[1])).all()
        starts = [e - x for e, x in zip(ends, (a, b))]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        assert list(zip(la.tolist(), lb.tolist())) == want


# --- spelling ---


def plain_variants(texts):
    n = Counter()
    for d, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    less = {w: {w[:k] + w[k + 1 :] for k in range(len(w))} for w in n if len(w) < 1000}
    holes = {w: {w[:k] + "?" + w[k + 1 :] for k in range(len(w))} for w in less}
    by = {}
    for w in holes:
        for x in holes[w]:
            by.setdefault(x, set()).add(w)
    near = {w: set() for w in n}
    for own in by.values():
        for w in own:
            near[w] |= own - {w}
    for w in less:
        for x in less[w] & set(n):
            near[w].add(x)
            near[x].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling(spark, docs, none, texts):
    got = spelling.variants(docs)
    assert got.columns == COLUMNS
    same(got, plain_variants(texts))
    assert spelling.variants(none).count() == 0


def test_spelling_of_dense_words_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abÿ"), rng.integers(5, 9))) for _ in range(3000)] + ["a" * 40_000, "a" * 40_001, "a" * 20_000 + "b" + "a" * 19_999] * 3
    words += ["neighbour"] * 40 + ["neighbor"] * 90 + ["nieghbour"] * 5 + ["neighbou"] * 19 + ["neighbo"] * 9
    texts = [(None, " ".join(words)), (3, "neighbour"), (4, "Neighbor ÀBCDE")]
    cut = spelling.in_blocks
    monkeypatch.setattr(spelling, "in_blocks", lambda rows, key, unique: cut(rows, key, unique, 16))
    monkeypatch.setattr(spelling, "TILE", 1000)
    got = spelling.variants(spark.createDataFrame(texts, "doc_id long, text string"))
    want = plain_variants(texts)
    assert {w[0]: w[4] for w in want}["aaaaa"] > 5
    long = [w for w in want if len(w[0]) > 1000]
    assert len(long) == 3
    same(got.filter("length(word) < 1000"), [w for w in want if len(w[0]) < 1000])
    assert sorted(r.n_near for r in got.filter("length(word) > 1000").collect()) == [1, 1, 2]
    chain = {w[0]: w for w in want}
    assert chain["neighbo"][2] == "neighbor" and chain["neighbou"][1] == "neighbor"


def test_near_pairs_equal_edit_distance():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("ab"), 6)).encode() for _ in range(60)})
    shorter = sorted({w[:k] + w[k + 1 :] for w in words[:20] for k in range(6)} | {b"zzzzz"})
    for right, apart in ((words, lambda x, y: sum(a != b for a, b in zip(x, y)) == 1), (shorter, lambda x, y: any(x[:k] + x[k + 1 :] == y for k in range(len(x))))):
        want = {(i, j) for i, x in enumerate(words) for j, y in enumerate(right) if apart(x, y)}
        parts = [set(zip(*map(np.ndarray.tolist, spelling.near_pairs(words, right, p)))) for p in (0, 1)]
        assert parts[0] | parts[1] == want and not parts[0] & parts[1]


# --- coded ids ---


def test_words_have_the_ids_of_the_vocabulary_file(spark):
    """Random words of every kind of letter, and all entries of the vocabulary joined in pairs."""
    rng = np.random.default_rng(5)
    whole = Tokenizer.from_file(huffman.vocabulary())
    letters = list("abcdeéîÀß019'.,-<|>SΣßİ中") + ["th", "in", "'s", "'ll", "tion", "<|endoftext|>", "e\u0301", "\u030c"]
    words = ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(4_000)]
    entries = [e.replace("</w>", "") for e in whole.get_vocab() if e.replace("</w>", "").isascii()]
    words += ["".join(rng.choice(entries, 2)) for _ in range(4_000)] + [r.text for r in table(spark, SF, "documents").collect()]
    words = list({w: 0 for text in words for w in text.replace("\n", " ").split(" ")})
    flat, sizes = huffman.Words(huffman.vocabulary(), 2)(words)[0]
    want = [e.ids for e in whole.encode_batch(words, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_code_lengths():
    rng = np.random.default_rng(4)

    def optimal(counts):
        import heapq

        heap, total = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            total += x
            heapq.heappush(heap, x)
        return total

    for _ in range(50):
        counts = rng.integers(0, 1000, rng.integers(2, 200))
        size = huffman.code_lengths(counts, 30).astype(int)
        assert (size > 0).tolist() == (counts > 0).tolist() and (size * counts).sum() == optimal(counts)
    steep = np.array([1, 1] + [2**k for k in range(1, 40)])
    for limit in (6, 8, 16):
        size = huffman.code_lengths(steep, limit).astype(int)
        assert size.max() <= limit and sum(2.0 ** -x for x in size) == 1
    assert huffman.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0] and huffman.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]
    assert huffman.code_lengths(np.ones(70_000, int)).max() == 17
    few = [min(sum(c * x for c, x in zip(counts, ls)) for ls in LENGTHS) for counts in ([1, 1, 8, 9], [1, 2, 4, 8], [5, 5, 5, 5])]
    assert [int((huffman.code_lengths(np.array(c), 3) * np.array(c)).sum()) for c in ([1, 1, 8, 9], [1, 2, 4, 8], [5, 5, 5, 5])] == few


LENGTHS = [ls for ls in np.ndindex(4, 4, 4, 4) if min(ls) and sum(2.0 ** -x for x in ls) <= 1]


@pytest.mark.parametrize("n, size", [(1, 5), (255, 300), (256, 2), (65_536, 40_000), (200_001, 70_000), (100_000, 1)])
def test_files_round_trip(tmp_path, n, size):
    rng = np.random.default_rng(n)
    ids = (size * rng.random(n) ** 4).astype(np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=size))
    with open(tmp_path / "x.ids", "wb") as out:
        writer, at, docs = huffman.Writer(out, lengths), 0, []
        while at < n:
            own = ids[at : at + int(rng.integers(1, 90_000))]
            docs.append((None if len(docs) == 1 else len(docs) - 5, len(own)))
            writer.add(docs[-1][0], own)
            at += len(own)
        writer.close()
    with open(tmp_path / "x.ids", "rb") as raw:
        import pyarrow as pa

        reader = huffman.Reader(pa.PythonFile(raw, "r"))
        assert reader.n == n and (reader.ids(0, n) == ids).all()
        names, sizes = reader.documents()
        assert list(zip(names, sizes.tolist())) == docs
        for _ in range(30):
            a, m = int(rng.integers(0, n)), int(rng.integers(0, 70_000))
            assert (reader.ids(a, m) == ids[a : a + m]).all()
        assert len(reader.ids(n, 5)) == 0


def test_huffman(spark, docs, none, texts):
    coder = Tokenizer.from_file(huffman.vocabulary())
    rows = [(d, t, [*coder.encode(t or "", add_special_tokens=False).ids, huffman.END_ID]) for d, t in texts]
    made = settle(huffman.encoded(docs), "encoded")
    same(made.selectExpr("doc_id", "hex(ids)"), [(d, np.array(ids, "<u2").tobytes().hex().upper()) for d, _, ids in rows])
    folder = new_folder(spark, "ids")
    files = huffman.write_ids(made, folder, huffman.vocabulary_size(huffman.vocabulary(), huffman.END_ID))
    assert files.agg({"n_docs": "sum"}).first()[0] == len(texts)
    got = sorted(huffman.read_documents(spark, folder).collect(), key=lambda r: r.start)
    assert got[0].start == 0 and all(x.start + x.n_tokens == y.start for x, y in zip(got, got[1:]))
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    key = lambda r: (r[0] is None, r)[0:1] + tuple(map(str, r))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=key) == sorted([(d, len(ids), crc(ids)) for d, _, ids in rows], key=key)


def test_huffman_of_an_empty_table(spark, none):
    folder = new_folder(spark, "ids")
    huffman.write_ids(settle(huffman.encoded(none), "encoded"), folder, 49_408)
    assert huffman.read_documents(spark, folder).count() == 0


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    folder = f"file:{tmp_path}/ids"
    rows = spark.createDataFrame([(i, np.full(i + 1, i, "<u2").tobytes()) for i in range(50)], "doc_id long, ids binary")
    huffman.write_ids(rows, folder, 50)
    name = spark.read.parquet(f"{folder}/files").first()["name"]
    (tmp_path / "ids" / f"000000-{'0' * 32}.ids").write_bytes((tmp_path / "ids" / name).read_bytes()[:20])
    assert huffman.read_documents(spark, folder).agg({"n_tokens": "sum"}).first()[0] == sum(range(51))


def test_units_forget_without_changing_ids():
    from docqa.llm.units import Units, ragged

    units = Units(lambda words: [ragged([[len(w)] * len(w) for w in words])], 1, keep=3)
    for words in (["a", "bb", "bb"], ["ccc", "dddd", "a"], ["bb", "a"], []):
        at, sizes = units.numbers([words])
        flat, n = units.rows[0].take(at)
        assert n.tolist() == [len(w) for w in words] and flat.tolist() == [len(w) for w in words for _ in w] and sizes.tolist() == [len(words)]




def test_chunks_of_alignment_run_over_small_batches(spark):
    """Texts come in batches bounded by bytes and a chunk is filled from several of them, so neither grows with the rows of a batch."""
    texts = [(i, f"word{i % 7} and more {i} words") for i in range(60)] + [(60, None), (None, ""), (3, "word and more")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    whole = sorted(map(str, alignment.summarise(docs).collect()))
    assert spark.conf.get(key) == before
    with arrow_bytes(spark, 200):
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
        assert len(sizes) > 3 and sum(r.n for r in sizes) == 63
        chunks = alignment._chunks(docs, alignment.vocabularies()).select("chunk", "doc_id").collect()
    assert len(chunks) == 1 and chunks[0].doc_id == [i for i, _ in texts]
    assert whole == sorted(map(str, alignment.summarise(docs).collect()))
