"""Piece encoding, vector codes and periodic runs against the library and brute force, with awkward rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from traceloom.llm import vector_codes
from traceloom.llm.pieces import PieceCodec, decode_pieces, encode_pieces, piece_digests
from traceloom.llm.periodic_runs import collapse_runs, collapse_texts, find_runs, planted, run_digests
from traceloom.llm.vector_codes import code_digests, compress_vectors, hilbert_order, shortlists

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Pieces --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def awkward_texts(library):
    rnd = random.Random(11)
    names = [library.id_to_piece(i) for i in range(len(library))]
    yield from ["", " ", "   ", "\n", "a", " a", "a ", "▁", "▁ ▁a", "a\x00b", "<s> </s> <unk> <0x41>", "é ﬁ ½ ①", "文字化け", "🙂🙃"]
    yield from [" " * 4097, "a" * 5001, "=" * 777 + " " * 33 + "\t\t\n" * 9]
    for k in range(1500):
        n = rnd.randrange(30)
        if k % 4 == 0:
            yield "".join(rnd.choice("ab \n▁eéth.,") for _ in range(2 * n))
        elif k % 4 == 1:
            yield "".join(rnd.choice(names) for _ in range(n))
        elif k % 4 == 2:
            yield "".join(chr(rnd.choice([rnd.randrange(0x80), rnd.randrange(0x80, 0x2FFF), rnd.randrange(0x1F300, 0x1F6FF)])) for _ in range(n))
        else:
            yield " ".join("".join(rnd.choice("aeinorst,.'") for _ in range(rnd.randrange(12))) for _ in range(n))


def test_pieces_equal_the_library(library):
    own = PieceCodec(MODEL)
    for text in awkward_texts(library):
        ids = library.encode(text)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(library):
    own = PieceCodec(MODEL)
    rnd = random.Random(12)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(300), rnd.randrange(len(library)), rnd.randrange(3, 259)]) for _ in range(rnd.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_small_memory_changes_no_ids(library, monkeypatch):
    monkeypatch.setattr("traceloom.llm.pieces.KEPT_UNITS", 3)
    monkeypatch.setattr("traceloom.llm.pieces.KEPT_PAIRS", 5)
    own = PieceCodec(MODEL)
    text = " ".join(random.Random(1).choice(["alpha", "beta,", "gamma", "delta.", "x"]) for _ in range(300))
    assert own.encode(text) == library.encode(text)


def test_piece_queries_on_awkward_rows(spark, library):
    rows = [(1, None, 5), (1, "two  words\n", 6), (None, "none", 7), (2, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((tuple(r) for r in piece_digests(docs, MODEL).collect()), key=repr)
    expected = []
    for doc, text, _ in rows:
        ids = library.encode(text or "")
        expected.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(expected, key=repr)
    back = decode_pieces(encode_pieces(docs, MODEL), MODEL).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id) == [(1, ""), (1, "two  words\n"), (2, "")]
    assert piece_digests(docs.limit(0), MODEL).collect() == []


# Periodic runs -------------------------------------------------------------------------------------------


def runs_by_force(words, least=6, exponent=4):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            smaller = any(all(words[start + k] == words[start + k - p] for k in range(p, length)) for p in range(1, q))
            if length >= max(least, exponent * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rnd, letters):
    words = []
    for _ in range(rnd.randrange(7)):
        unit = [rnd.choice(letters) for _ in range(rnd.randint(1, 9))]
        words += (unit * 8)[: rnd.randint(1, 7 * len(unit))]
    return words


@pytest.mark.parametrize("exponent", [3, 4])
def test_runs_equal_brute_force(exponent):
    rnd = random.Random(13)
    texts = [repetitive(rnd, "abc" if k % 2 else "abcdefghij") for k in range(600)]
    texts += [["a"] * 70, ["a", "b"] * 40 + ["a"], list("aabaab" * 9), []]
    found = collapse_texts([" ".join(t) for t in texts], 6, exponent)
    total = 0
    for words, (runs, n, collapsed) in zip(texts, found):
        expected = runs_by_force(words, 6, exponent)
        dropped = {i for s, length, q in expected for i in range(s + q, s + length)}
        assert [tuple(r) for r in runs.tolist()] == expected and n == len(words)
        assert collapsed.decode() == " ".join(w for i, w in enumerate(words) if i not in dropped)
        total += len(expected)
    assert total > 300


def test_runs_of_a_long_text_take_linear_memory():
    words = np.zeros(300_000, np.int64)
    words[150_000] = 1
    assert find_runs(words).tolist() == [[0, 150_000, 1], [150_001, 149_999, 1]]


def test_run_digests_with_planted_repeats(spark):
    rnd = random.Random(14)
    rows = [(k, " \t".join(repetitive(rnd, "abcd") + [f"w{i}" for i in range(rnd.randrange(40))]), 1) for k in range(120)]
    rows += [(7, None, 1), (None, "x y z " * 5, 1), (8, " \n ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    expected = []
    for doc, text, _ in rows:
        words = (text or "").split()
        h = zlib.crc32(("" if doc is None else str(doc)).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_force(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        expected.append(
            (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
             sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
             sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))
        )
    got = run_digests(planted(docs)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert any(e[1] for e in expected)
    assert run_digests(planted(docs.limit(0))).collect() == []
    assert collapse_runs(docs).columns == ["doc_id", "n_words", "runs", "collapsed"]


# Shared hashes and column names ---------------------------------------------------------------------------


def colliding_words():
    """Two words that every sum of bytes times powers of an odd base modulo 2^64 confuses (a Thue-Morse pair)."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_words_with_equal_sums_stay_apart(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from traceloom.llm.common import Words
    from traceloom.llm.encoder import WordEncoder
    from traceloom.llm.near_dup import near_duplicates

    a, b = colliding_words()
    words = Words(pa.array([f"{a} {b} {a}."], pa.large_string()))
    plain = (words.sums[words.ends] - words.sums[words.starts]) * words.down[words.starts]
    assert plain[0] == plain[1]
    assert words.hashes[0] != words.hashes[1]
    assert words.hash(words.ends - np.array([0, 0, 1]))[2] == words.hashes[0]
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [a, b, f"{a}, {b}. {a}"]
    found = WordEncoder(path).encode(pa.array(texts))
    assert [x.tolist() for x in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()) == [(1, 1, True), (2, 2, True), (3, 1, False)]


def test_stages_keep_columns_with_dots(spark):
    from traceloom.llm.decontamination import keep_clean
    from traceloom.llm.near_dup import keep_representatives
    from traceloom.llm.quality import keep_quality

    rows = [(k, f"some words of text number {k} and {k * 7} more of them", k, "x") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `meta.lang` int, `a``b` string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, rows[2][1])], "item_id long, text string")
    assert keep_quality(docs, labels, cut=0.0).collect() == docs.collect()
    assert keep_representatives(docs).columns == docs.columns
    left = keep_clean(docs, items).collect()
    assert sorted(r["meta.lang"] for r in left) == [0, 1, 3, 4, 5, 6, 7] and left[0]["a`b"] == "x"


def test_windows_of_a_document_equal_brute_force(spark):
    """Every (document, item, window, similarity) over edited copies inside other text."""
    from traceloom.llm.decontamination import Items, item_words
    from traceloom.llm.common import shingle_hashes

    rnd = random.Random(15)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [" ".join(word() for _ in range(rnd.randint(20, 40))) for _ in range(12)]
    index = Items(list(range(12)), items)
    found = missed = 0
    for k in range(200):
        copy = [word() if rnd.random() < 0.02 else w for w in items[k % 12].split()]
        words = item_words(" ".join([word() for _ in range(rnd.randrange(60))] + copy + [word() for _ in range(rnd.randrange(60))]))
        got = {m[0]: m[1:] for m in index.matches(words, 0.8)}
        shingles = shingle_hashes(words)
        places = index.positions(shingles)
        for item in range(12):
            best = None
            for length in sorted({len(item_words(t)) for t in items}):
                length = min(length, len(words))
                for at in range(len(words) - length + 1):
                    span = slice(at, at + max(1, length - 4))
                    value = index.similarity(places[span], shingles[span], item)
                    if value >= 0.8 and (best is None or (-value, length, at) < best):
                        best = (-value, length, at)
            if best:
                found += 1
                missed += item not in got
                if item in got:
                    assert got[item] == (best[2], best[1], -best[0])
            else:
                assert item not in got
    assert found > 100 and missed <= 1


def test_work_for_a_planted_item(monkeypatch):
    """Windows too light for the item are not fingerprinted; windows in which no shingle repeats are not verified one by one."""
    from traceloom.llm.decontamination import Items, item_words

    rnd = random.Random(16)
    fresh = lambda n: " ".join(f"u{rnd.getrandbits(60)}" for _ in range(n))
    texts = [fresh(n) for n in range(15, 60)]
    index = Items(list(range(len(texts))), texts)
    rows, single = [], []
    near, similarity = Items.near, Items.similarity
    monkeypatch.setattr(Items, "near", lambda self, prints: rows.append(len(prints)) or near(self, prints))
    monkeypatch.setattr(Items, "similarity", lambda self, *a: single.append(1) or similarity(self, *a))
    found = index.matches(item_words(f"{fresh(100)} {texts[40]} {fresh(100)}"), 0.8)
    assert found == [(40, 100, 55, 1.0)]
    # The item has 51 shingles: windows have 41 at least, 55 at most, and hold the item's to four fifths.
    inside = lambda at, n: min(51, at + n) - max(0, at)
    assert sum(rows) <= sum(inside(at, n) >= 0.7999 * n for n in range(41, 56) for at in range(-n, 51)) and not single


def test_texts_of_a_slice_equal_brute_force():
    """Every (text, item, window, similarity) where shingles repeat in windows, texts are short or hold no words."""
    import pyarrow as pa

    from traceloom.llm.common import NOT_ALNUM, Words, shingle_hashes
    from traceloom.llm.decontamination import Items

    rnd = random.Random(17)
    word = lambda: f"w{rnd.randrange(300)}"
    items = [" ".join(word() for _ in range(rnd.randint(12, 30))) for _ in range(8)]
    loop = [word() for _ in range(7)]
    items += [" ".join(loop * 3 + [word() for _ in range(6)]), " ".join(["ha"] * 12), "two words"]
    index = Items(list(range(len(items))), items)
    texts = [None, "", "two words", "Two, WORDS!", "w1", "two words more than items hold"]
    for k in range(120):
        copy = [word() if rnd.random() < 0.02 else w for w in items[k % 10].split()]
        lead = rnd.choice([[], loop * 2, ["ha"] * 7, [word() for _ in range(rnd.randrange(30))]])
        texts.append(" ".join(lead + copy + copy[: rnd.randrange(len(copy))] + lead))
    slice_words = Words(pa.array([t or "" for t in texts], pa.large_string()), NOT_ALNUM)
    got = dict(index.search(slice_words.hashes, slice_words.at, 0.8))
    found = missed = 0
    for k in range(len(texts)):
        words = slice_words.hashes[slice_words.at[k] : slice_words.at[k + 1]]
        shingles = shingle_hashes(words)
        places = index.positions(shingles)
        mine = {m[0]: m[1:] for m in got.get(k, [])}
        for item in range(len(items)):
            best = None
            for length in sorted({min(n, len(words)) for n in index.words}) if len(words) else ():
                if (length < 5) != (len(words) < 5):
                    continue  # shingles are those of the whole text: of five words, or the whole of it
                for at in range(len(words) - length + 1):
                    span = slice(at, at + max(1, length - 4))
                    value = index.similarity(places[span], shingles[span], item)
                    if value >= 0.8 and (best is None or (-value, length, at) < best):
                        best = (-value, length, at)
            if best:
                found += 1
                missed += item not in mine
                if item in mine:
                    assert mine[item] == (best[2], best[1], -best[0])
            else:
                assert item not in mine
    assert found > 80 and missed <= 1


# Vector codes --------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, codes string, v int"


def codes_by_force(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max((len(v) for _, v, _ in kept), default=0)
    x = np.array([v + [0] * (width - len(v)) for _, v, _ in kept], dtype=object).reshape(len(kept), width)
    cuts = [width * k // parts for k in range(parts + 1)]
    books = [[list(r) for r in x[:entries, a:b]] for a, b in zip(cuts, cuts[1:])]

    def assign():
        out = []
        for row in x:
            found = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                d = [sum((p - q) ** 2 for p, q in zip(row[a:b], e)) for e in books[k]]
                found.append((min(d), d.index(min(d))))
            out.append(found)
        return out

    for _ in range(rounds):
        near = assign()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for e in range(len(books[k])):
                members = [x[i, a:b] for i in range(len(kept)) if near[i][k][1] == e]
                if members:
                    books[k][e] = [sum(c) // len(members) for c in zip(*members)]
    near = assign()
    errors = [sum(d for d, _ in f) for f in near]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = sha(",".join(str(c) for book in books for e in book for c in e))
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[lab], digest) for (i, _, lab), f, e in zip(kept, near, errors)]


def vector_rows(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = [(i, (centres[i % 5] + rng.normal(size=width) * 0.05 * (i % 3)).tolist(), None if i % 4 == 0 else i % 3) for i in range(n)]
    return [(i, np.array(v, np.float32).tolist(), lab) for i, v, lab in rows]


def check_codes(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS).repartition(parts)
    got = [tuple(r) for r in code_digests(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, codes_by_force(rows)))


@pytest.mark.parametrize("width", [16, 20])
def test_codes_equal_brute_force(spark, monkeypatch, width):
    rows = vector_rows(260, width, width)
    rows += [(1000 + k, rows[3][1], 1) for k in range(150)]  # ties and repeated rows
    rows += [(None, rows[5][1], None), (7, rows[6][1], 2), (2000, None, 1), (2001, [1.0] * (width - 1) + [None], 1)]
    rows += [(2002, [float("nan")] * width, 1), (2003, [float("inf")] * width, 1), (2004, rows[1][1][:5], 1), (2005, [], 0)]
    check_codes(spark, rows)


def test_codes_of_few_and_no_vectors(spark):
    check_codes(spark, vector_rows(3, 16, 1))
    check_codes(spark, [(1, None, 1)])
    check_codes(spark, [(1, [], 1), (2, [], None)])


def test_codes_equal_their_sql(spark):
    rows = vector_rows(300, 16, 5)
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)
    con = duckdb.connect()
    con.register("embeddings", frame.select("vec_id", "embedding", "label").toArrow())
    want = con.execute(vector_codes.oracle()).fetchall()
    names = [d[0] for d in con.description]
    got = code_digests(frame.repartition(2))
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want))


def test_small_blocks_and_chunks_change_nothing(spark):
    rows = vector_rows(200, 16, 6)
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)
    coded, books = compress_vectors(frame, parts=2, entries=5, rounds=3)
    assert coded.count() == 200 and [b.shape for b in books] == [(5, 8), (5, 8)]


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(2)
    for _ in range(300):
        points = rng.integers(-50, 50, size=(20, 3))
        book = rng.integers(-60, 60, size=(6, 3))
        short = shortlists(points.min(axis=0)[None], points.max(axis=0)[None], book)[0]
        distance = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert short[np.flatnonzero((distance == distance.min(axis=1, keepdims=True)).any(axis=0))].all()


def test_hilbert_order_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    steps = np.abs(np.diff(grid[hilbert_order(grid)], axis=0)).sum(axis=1)
    assert (steps == 1).all()
    assert sorted(hilbert_order(grid).tolist()) == list(range(512))
    assert hilbert_order(np.zeros((0, 4), np.int64)).tolist() == []
    assert hilbert_order(np.zeros((3, 0), np.int64)).tolist() == [0, 1, 2]
    assert len(hilbert_order(np.random.default_rng(1).integers(0, 9, (50, 70)))) == 50
