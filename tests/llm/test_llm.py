"""The training-data operators against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from traceloom.llm import licences, warc
from traceloom.llm.chat import CONTROLS, FOREIGN, conversation_digests, escape, unescape
from traceloom.llm.common import NOT_ALNUM, Words, connected_components, local_components
from traceloom.llm.decontamination import Items, contamination, keep_clean
from traceloom.llm.encoder import WordEncoder
from traceloom.llm.id_files import decode_ids, encode_ids, id_digests
from traceloom.llm.near_dup import keep_representatives, near_duplicates
from traceloom.llm.packing import Levels, pack_documents
from traceloom.llm.quality import keep_quality, quality_scores
from traceloom.llm.scoring import score_texts
from traceloom.llm.vector_dup import vector_links

WORDS = public_tokenizers.path("word_bpe_49k.json")
CHAT = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "doc_id long, text string, node string, key int, tokens int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {0: None, 1: "", 2: " \n\t ", 3: "One", 4: "one", 5: "a b c d e", 6: "É'S o'clock <|endoftext|> x|y 9."}
    texts[7] = " ".join(rnd.choice(vocabulary) for _ in range(9000))
    base = [rnd.choice(vocabulary) for _ in range(300)]
    for k in range(8, 40):
        copy = [("X%d" % rnd.randint(0, 9) if rnd.random() < 0.006 * (k % 5) else w) for w in base]
        texts[k] = " ".join(copy).upper() if k % 7 == 0 else " ".join(copy)
    for k in range(40, 60):
        texts[k] = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 200)))
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "n", 1, 2) for k, t in texts.items()], EXTRA).repartition(3)


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    return {k: tokenizer.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_word_encoder_equals_the_tokenizer(texts, ids):
    found = WordEncoder(WORDS).encode(pa.array(list(texts.values())), 1)
    assert [x.tolist() for x in found] == [[*ids[k], 1] for k in texts]


def test_packing(spark, docs, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack_documents(docs, WORDS).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for k, rows in pieces.items():
        whole, at = [*ids[k], 2], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(whole), crc(whole[at : at + r.length]))
            at += r.length
        assert at == len(whole)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert pack_documents(docs.where("false"), WORDS).count() == 0
    repeated = pack_documents(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"), WORDS)
    assert [r.length for r in repeated.collect()] == [3, 3]


def test_levels_choose_the_smallest_sum_of_squares():
    rnd = random.Random(1)
    levels, counts = Levels(12), Counter()
    for _ in range(300):
        n = rnd.randint(1, 11)

        def after(g):
            new = counts.copy()
            if g:
                new[g] -= 1
            if g + n < 12:
                new[g + n] += 1
            return sum(v * v for v in new.values())

        options = [0] + [g for g in range(1, 13 - n) if counts[g]]
        best = min(options, key=lambda g: (after(g), -g))
        expected = after(best)
        levels.place((0, 0, None, n), n)
        if best:
            counts[best] -= 1
        if best + n < 12:
            counts[best + n] += 1
        assert sum(int(v) ** 2 for v in levels.counts) == expected


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    cases = [[], [0] * 1000, [5], rng.integers(0, 50000, 5000), rng.integers(0, 2, 700), [2**63, 1, 2**61, 2**60 - 1, 14]]
    for case in cases:
        case = np.array(case, np.uint64)
        packed, offsets = encode_ids(case)
        assert offsets[-1] == len(packed) and (decode_ids(packed, len(case), offsets) == case).all()


def test_id_files(spark, docs, ids):
    at = 0
    for r in sorted(id_digests(docs, WORDS).collect()):
        whole = [*ids[r.doc_id], 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(whole), crc(whole))
        at += len(whole)
    odd = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r.start for r in id_digests(odd, WORDS).collect()) == [0, 2, 4]
    assert id_digests(docs.where("false"), WORDS).count() == 0


def brute_components(texts):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[b] > label[a]:
                    label[b], changed = label[a], True
    return sets, label


def test_near_duplicates(docs, texts):
    sets, label = brute_components(texts)
    found = near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found} == {
        (k, len(sets[k]), label[k], label[k] == k) for k in texts
    }
    left = keep_representatives(docs.unionAll(docs))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k in texts if label[k] == k)
    assert near_duplicates(docs.where("false")).count() == 0
    assert keep_representatives(docs.where("false")).count() == 0


def test_rows_are_judged_by_their_texts_not_their_ids(spark):
    text = lambda name, k=60: " ".join(f"{name}{i}" for i in range(k))
    near = lambda name: text(name) + " changed"
    rows = [
        (1, text("a"), "a"), (7, near("a"), "a near"), (7, text("b"), "b"), (7, text("c"), "c"), (3, near("c"), "c near"),
        (9, text("d"), "d"), (9, near("d"), "d near"), (None, text("a"), "null a"), (None, text("e"), "e"),
        (None, text("e"), "e again"), (None, near("e"), "e near"), (None, text("b"), "null b"), (None, None, "none"),
        (None, None, "none again"), (5, "", "blank"), (5, "", "blank again"), (5, " ", "other blank"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_number string").repartition(3)
    left = keep_representatives(docs)
    assert left.columns == docs.columns
    names = sorted(r.row_number.split()[0] if r.row_number[0] in "de" else r.row_number.removesuffix(" again") for r in left.collect())
    assert names == ["a", "b", "blank", "c near", "d", "e", "none", "none", "other blank"]
    found = near_duplicates(docs).collect()
    assert sorted(r.component_id or 0 for r in found if r.kept) == [0, 0, 0, 1, 3, 5, 5, 7, 9]
    benchmark = spark.createDataFrame([(0, text("a"))], "item_id long, text string")
    clean = {r.row_number for r in keep_clean(docs, benchmark).collect()}
    assert clean == {name for _, _, name in rows} - {"a", "a near", "null a"}


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rnd.randint(0, 60), 100 + rnd.randint(0, 60)) for _ in range(30)]
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    rows = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {n: c for n, c in label.items() if any(a != b and n in (a, b) for a, b in pairs)}
    a, b = np.array(pairs).T
    assert local_components(200, a, b)[list(label)].tolist() == list(label.values())


def test_decontamination(spark):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60)))) for i in range(20)]
    rows, held = [(0, None), (1, ""), (2, "w1"), (3, " ".join(rnd.choice(vocabulary) for _ in range(500)))], set()
    for k in range(4, 44):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 300))]
        at = rnd.randint(0, len(w))
        item = items[k % 20][1].upper().replace(" ", ", ")
        rows.append((k, " ".join(w[:at]) + " " + item + " " + " ".join(w[at:])))
        held.add((k, k % 20))
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    for size in (1 << 20, 2000):  # one pass and several
        found = contamination(docs, benchmark, pass_bytes=size).collect()
        assert {(r.doc_id, r.item_id) for r in found if r.similarity == 1.0} >= held
        assert not {r.doc_id for r in found} & {0, 1, 2, 3}
    assert {r.doc_id for r in keep_clean(docs, benchmark).collect()} == {0, 1, 2, 3}
    assert contamination(docs, benchmark.where("false")).count() == 0


def brute_similarity(a, b, frequency, n):
    weigh = lambda shingles: sum(math.log1p(n / frequency.get(x, 1)) for x in shingles)
    return weigh(a & b) / weigh(a | b)


@pytest.mark.parametrize("sharers", [1, 100, 333])
def test_edited_copies_of_shared_items(sharers):
    """Copies of passages that ``sharers`` of 1000 items hold, with words changed, at similarities from 0.8 to 0.9."""
    rnd = random.Random(sharers)
    n = 1000
    fresh = lambda k: [f"u{rnd.getrandbits(60)}" for _ in range(k)]
    shared = fresh(204)
    texts = [shared] * sharers + [fresh(6) for _ in range(n - sharers)]
    items = Items(list(range(n)), [" ".join(t) for t in texts])
    pieces = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    item, frequency = pieces(shared), {x: sharers for x in pieces(shared)}
    expected = missed = 0
    while expected < 40:
        copy = list(shared)
        for at in rnd.sample(range(204), rnd.randint(1, 6)):
            copy[at] = fresh(1)[0]
        if 0.8 <= brute_similarity(pieces(copy), item, frequency, n) <= 0.9:
            expected += 1
            data = pa.array([" ".join(copy)], pa.large_string())
            found = {m[0] for m in items.matches(Words(data, NOT_ALNUM).hashes, 0.8)}
            missed += 0 not in found
    assert missed <= 1


def test_one_pass_over_the_benchmark_equals_many(spark):
    rnd = random.Random(8)
    fresh = lambda k: [f"u{rnd.getrandbits(60)}" for _ in range(k)]
    head, tail = fresh(40), fresh(30)
    texts = [head + fresh(rnd.randint(3, 12)) for _ in range(30)] + [fresh(9) + tail for _ in range(30)] + [fresh(25) for _ in range(30)]
    rows = []
    for k in range(120):
        copy = list(rnd.choice(texts))
        copy[rnd.randrange(len(copy))] = fresh(1)[0]
        rows.append((k, " ".join(fresh(rnd.randint(0, 20)) + copy + fresh(rnd.randint(0, 20)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "item_id long, text string")
    one, many = ({tuple(r) for r in contamination(docs, benchmark, pass_bytes=size).collect()} for size in (1 << 20, 10_000))
    assert len({r[4] for r in one}) > 5 and one == many


def test_quality(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["the", "house", "green", "walks", "over"]) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join([rnd.choice(["BUY!!", "NOW!!", "| |"])] * 60)
    rows = [(k, bad() if k % 4 == 0 else good(), "x") for k in range(400)] + [(1000, None, "x"), (1001, "", "x"), (None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(400)] + [(1, None), (None, 1)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(400))
    held = [k for k in range(400) if found[k].held_out]
    assert sum(found[k].predicted == int(k % 4 != 0) for k in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in keep_quality(docs, labels).collect()}
    assert kept == {k for k, r in found.items() if r.predicted}
    assert {r.score for r in quality_scores(docs, labels.where("false")).collect()} == {0.5}


def test_scoring(docs, texts):
    from math import log10

    found = {r.doc_id: r for r in score_texts(docs).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    tokens = {k: [*words(t), None] for k, t in texts.items()}
    count = Counter(w for k in texts if not held[k] for w in tokens[k])
    n, v = sum(count.values()), len(count)
    for k, w in tokens.items():
        r = found[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0
    assert score_texts(docs.where("false")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    x = np.concatenate((base, base[:20] + rng.normal(size=(20, 16)) * 0.1, base[:5], np.repeat(base[:1], 30, 0)))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 15, [float("inf")] + [1.0] * 15]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    found = {r.vec_id: r for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    label = np.arange(len(x))
    for _ in x:
        label = np.array([label[row].min() for row in near])
    got = [(found[i].n_links, found[i].component_id, found[i].kept) for i in range(len(x))]
    assert got == [(int(near[i].sum()) - 1, int(label[i]), bool(label[i] == i)) for i in range(len(x))]
    assert all((found[1000 + i].n_links, found[1000 + i].component_id) == (0, 1000 + i) for i in range(len(odd)))


def test_chat(spark):
    for text in ("<s>", "<\\s>", "<\\\\s> <s", "a<|turn|><<SYS>>", "[\\INST]", "<<s>>", "</s>[INST] ok [/INST]"):
        assert unescape(escape(text)) == text and not any(c in escape(text) for c in (*CONTROLS, *FOREIGN))
    rows = [(None, None, None, None, 1), (1, 0, "assistant", "", 2), (1, 0, "assistant", "é́😀\x00 <|turn|>", 2), (1, 1, "wéird<|role|>", "x", 3), (2, 0, "tool", "y" * 100000, 3)]
    found = conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int"), CHAT)
    found = {r.conv_id: r for r in found.collect()}
    plain = "assistant\n\nassistant\né́😀\x00 <|turn|>\nwéird<|role|>\nx\n"
    assert found[1].turns_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert (found[1].n_turns, found[1].loss_chars) == (3, len("é́😀\x00 <|turn|>"))
    assert found[1].loss_sha256 == hashlib.sha256("é́😀\x00 <|turn|>".encode()).hexdigest()
    assert (found[None].n_turns, found[2].n_turns, found[2].loss_chars) == (1, 1, 0)


def test_licences(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "Released under the MIT License.\nUnder the mit-license", 0), (4, "CC BY-NC 4.0 cc by nc", 0), (5, "under the ÄMIT license apache", 0), (6, "GNU General Public License, version 3. " * 500, 0), (7, "Permission is hereby granted, free of charge, to any person obtaining one copy of this software", 0)]
    found = {r.doc_id: r for r in licences.licence_labels(spark.createDataFrame(rows, "doc_id long, text string, raw int")).collect()}
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].labels, found[1].score) == (0, 0, None, "", 0.0)
    assert (found[3].n_base, found[3].first_word, found[3].last_word, found[3].base_labels) == (2, 1, 5, "mit")
    assert (found[4].n_base, found[4].last_word, found[4].base_labels) == (2, 5, "cc-by-nc")
    assert (found[5].labels, found[6].labels, found[6].n_base) == ("", "gpl-3", 0)
    assert found[7].labels == "mit" and 0.8 <= found[7].score < 1


def test_warc(spark, tmp_path):
    html = "<html><title> A\nb </title><script>x<p></script><p>One &amp; two<br>three</p><a href=\"/l\">go</a>"
    pages = spark.createDataFrame([(1, "u", html, 0), (2, None, None, 0), (None, "u", "", 0)], "page_id long, url string, html string, links int")
    found = warc.derivatives(warc.responses(pages))
    rows = {(r.page_id, r.warc_type): r for r in found.collect()}
    text, meta = rows[1, "conversion"], rows[1, "metadata"]
    assert text.content == "A\nb\nOne & two\nthree\ngo" and text.refers_to == meta.refers_to != text.record_id
    assert text.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert "title: A b" in meta.content and "outlink: /l" in meta.content and len(rows) == 6
    warc.write_warc(found, str(tmp_path / "out"), "2024-01-01T00:00:00Z")
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part*")))
    assert written.count(b"WARC/1.1\r\n") == 6 and f"WARC-Refers-To: {text.refers_to}\r\n".encode() in written


def test_outlinks_of_all_forms(spark):
    html = (
        '<a href="/1">x</a><A HREF="/2"><a class="b c" id=d download href="/3"><a\n\thref = \'/4"\'><a rel=x href=/5/e?f=g>h</a>'
        '<a title="x href=\'/no\' >" href="/6"><a data-href="/no" href=/7><a title=it\'s href="/8"><a title="i"href="/9">'
        '<a href=""><abbr href="/no"><a name="j"> href="/no"<a href><link href="/no"><SCRIPT>"<a href="/no">"</SCRIPT>'
        '<!-- <a href="/no"> --><style><a href=/no></style><a title="<!--" href="/10">--><a href="é&amp;k">'
    )
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "<a " + "k=v " * 20000 + "href=/l>"), (3, "u", None)], "page_id long, url string, html string")
    found = {r.page_id: r.content for r in warc.derivatives(warc.responses(pages)).where("warc_type = 'metadata'").collect()}
    links = {k: [x.removeprefix("outlink: ") for x in v.split("\r\n") if x.startswith("outlink: ")] for k, v in found.items()}
    assert links[1] == ["/1", "/2", "/3", '/4"', *(f"/{k}" if k != 5 else "/5/e?f=g" for k in range(5, 10)), "", "/10", "é&amp;k"]
    assert (links[2], links[3]) == (["/l"], [])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pack"]
    good = " ".join(f"word{i}" for i in range(80))
    item = "this passage belongs to the benchmark and must never be trained on by anyone"
    rows = [(0, good), (1, good), (2, good + " " + item), (3, None)] + [(k, f"text {k} of its own kind here " * 3) for k in range(4, 12)]
    spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 3, *range(4, 12)}
