"""Operators that SQL cannot express, against plain versions of themselves."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from wirelark.llm import bpe, entries, id_files, labelled, mixing, quality_model, simhash, substrings, toxicity
from wirelark.llm.vocabulary import BYTE_TOKENIZER, WORD_TOKENIZER


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# SimHash


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id by fingerprint, by comparing all pairs."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for doc, p in prints:
        if doc is not None:
            least[find(p)] = min(doc, least.get(find(p), doc))
    return {p: least.get(find(p)) for p in distinct}


def check_simhash(docs):
    prints = [(d, plain_print(t)) for d, t in texts(docs)]
    component = plain_components(prints)
    assert rows(simhash.near_duplicates(docs)) == Counter((d, f"{p:016x}", component[p]) for d, p in prints)


def test_simhash_documents(documents):
    check_simhash(documents)


def test_simhash_edge(edge):
    check_simhash(edge)
    assert simhash.near_duplicates(edge.where("false")).count() == 0


def test_ball_links_and_components(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints):  # chains and dense balls
        for _ in range(12):
            prints.add(p)
            p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        prints |= {p ^ (1 << b) for b in range(64)} if rng.random() < 0.2 else set()
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.connected(simhash.ball_links(spark.createDataFrame(signed, "print long")))
    got = {}
    for node, root in found.collect():
        got.setdefault(root, set()).add(node % (1 << 64))
    want = {}
    ids = {p: i for i, p in enumerate(sorted(prints))}
    for p, least in plain_components([(ids[p], p) for p in prints]).items():
        want.setdefault(least, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_near_copies_leave_one_row(spark, documents):
    """Copies with a few words changed, in chains: components of fingerprints at most two bits apart leave their first row."""
    rng = random.Random(9)
    made = []
    for base in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 300, 1500]))]
        made.append((len(made), " ".join(words)))
        for _ in range(3):
            words = list(words)
            for _ in range(rng.randrange(1, max(2, len(words) // 50))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            made.append((len(made), " ".join(words)))
    component = plain_components([(d, plain_print(t)) for d, t in made])
    assert 60 < len(set(component.values())) < len(made)
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in made], documents.schema)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(component.values())


def test_one_row_of_each_component_keeps_its_text(spark, edge):
    """Repeated rows, null ids and an id that two texts share: one copy is left, and passage removal does not erase it."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    made = [(8, a), (8, a), (None, b), (None, b), (3, c), (5, c), (5, d), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.near_duplicates(spark, docs, "")
    assert rows(once.select("doc_id", "text")) == Counter([(8, a), (None, b), (3, c), (5, d)])
    left = corpus_pipeline.passages(spark, spark.createDataFrame(once.collect(), once.schema), "")
    assert Counter(r["text"] for r in left.collect()) == Counter([a, b, c, d])
    long = corpus_pipeline.near_duplicates(spark, edge, "").where("n_chars > 100000").collect()
    assert [r["doc_id"] for r in long] == [7]


# Passages


def test_windows_are_told_apart_and_found_again():
    rng = random.Random(1)
    words = [f"w{rng.randrange(5)}".encode() for _ in range(3000)]
    w = substrings.Windows([b" ".join(words[:1000]), b" ".join(words[1000:])], 4)
    runs = [tuple(words[i : i + 4]) for i in range(1000 - 3)] + [tuple(words[i : i + 4]) for i in range(1000, 3000 - 3)]
    by_hash = {}
    for run, a, b in zip(runs, w.first.tolist(), w.second.tolist(), strict=True):
        by_hash.setdefault((a, b), set()).add(run)
    assert len(by_hash) == len(set(runs)) and all(len(v) == 1 for v in by_hash.values())


def test_sketch_loses_no_window(documents):
    """However narrow the sketch, nothing that repeats is lost."""
    wide = rows(substrings.repeated(documents, 35))
    cells = substrings.CELLS_PER_BYTE
    try:
        substrings.CELLS_PER_BYTE, substrings.SLICE_BITS = 0, 17
        narrow = rows(substrings.repeated(documents, 35))
    finally:
        substrings.CELLS_PER_BYTE, substrings.SLICE_BITS = cells, 24
    assert narrow == wide


# Tokenizers

ODD = [
    "", "  ", "áb İΣΑΣ ς <|startoftext|>x<|endoftext|> \x1cfoo\x1f bar baz　q it's WE'RE 12345 ½ ²",
    "日本語 テスト 한국어 \U0001f600\U0001f468‍\U0001f469", "﻿é ́ x", "aaaaaaa lolololol hahahaha !!!!!!!! -------",
    "<|endoftext|><|endoftext|> <|endoftext |>", "a  b   c \n d\n e \n\n f", "\n x", "x \n", " \t y\t z ",
]


def odd_texts():
    rng = random.Random(2)
    out = list(ODD)
    for alphabet, n in (("abcdefghilnorst' .,!\n<|>éßñ19\t", 200), ("aeinst", 30), ("ab", 30)):
        out += ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(300)]
    return out + ["".join(chr(rng.choice([32, 10, rng.randrange(1, 0x3000)])) for _ in range(80)) for _ in range(200)]


@pytest.fixture(scope="module")
def word_codec():
    return bpe.WordCodec(open(WORD_TOKENIZER, encoding="utf-8").read())


def test_automaton_encodes_as_the_library(word_codec):
    library = word_codec.tokenizer
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert [int(i) for b in word_codec.id_blocks(text.encode()) for i in b.split()] == ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert word_codec.decode(ids) == decoded
        want = (len(ids), " ".join(map(str, ids)), decoded)
        assert word_codec.digests(text.encode()) == (want[0], *(hashlib.sha256(x.encode()).hexdigest() for x in want[1:]))


def test_automaton_of_random_merges():
    """Against merging pair by pair, with merges of equal letters among them."""
    rng = random.Random(5)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        while len(merges) < 12:
            u, v = (rng.choice(list(vocab)) for _ in range(2))
            if u + v not in vocab and len(u + v) < 9:
                merges.append((u, v))
                vocab[u + v] = len(vocab)
        automaton = bpe.MergeAutomaton(vocab, merges)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            tokens = list(word)
            for u, v in merges:
                i = 0
                while i < len(tokens) - 1:
                    if tokens[i] == u and tokens[i + 1] == v:
                        tokens[i : i + 2] = [u + v]
                    i += 1
            assert automaton.encode(word) == [vocab[t] for t in tokens]


def check_round_trip(docs):
    library = Tokenizer.from_file(WORD_TOKENIZER)
    want = Counter()
    for doc, text in texts(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        want[(doc, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in shown))] += 1
    assert rows(bpe.round_trip(docs, WORD_TOKENIZER)) == want


def test_bpe_documents(documents):
    check_round_trip(documents)


def test_bpe_edge(spark, edge):
    check_round_trip(edge)
    assert bpe.round_trip(edge.where("false"), WORD_TOKENIZER).count() == 0
    library = Tokenizer.from_file(WORD_TOKENIZER)
    ids = bpe.encoded(edge, WORD_TOKENIZER)
    want = Counter()
    for doc, text in texts(edge):
        want[(doc, library.decode(library.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False))] += 1
    assert rows(bpe.decoded(ids, WORD_TOKENIZER)) == want


def altered(path, **changes):
    spec = json.loads(open(path, encoding="utf-8").read())
    for place, value in changes.items():
        at = spec
        *way, last = place.split("__")
        for name in way:
            at = at[int(name) if isinstance(at, list) else name]
        at[last] = value
    return json.dumps(spec)


SEPARATOR = {"id": 1002, "content": "[SEP]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
MIXED = ["A [SEP] b[SEP]C", "Ábc  DEF\nx", " lead and trail ", "don't [S EP] stop"]


@pytest.mark.parametrize(
    "changes",
    [
        {"normalizer": None},
        {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}, {"type": "Replace", "pattern": {"String": "a"}, "content": "b"}]}},
        {"added_tokens": [SEPARATOR]},
        {"added_tokens": [SEPARATOR | {"content": "S EP", "id": 1003}]},
        {"normalizer": {"type": "Lowercase"}},
    ],
)
def test_word_codec_obeys_the_file(changes):
    text = altered(WORD_TOKENIZER, **changes)
    codec, library = bpe.WordCodec(text), Tokenizer.from_str(text)
    for t in ODD + MIXED:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert [int(i) for b in codec.id_blocks(t.encode()) for i in b.split()] == ids
        assert codec.digests(t.encode())[0] == len(ids)


@pytest.mark.parametrize(
    "changes", [{"decoder": {"type": "Fuse"}}, {"pre_tokenizer": None}, {"model__unk_token": "<unk>"}, {"added_tokens": [SEPARATOR | {"lstrip": True}]}]
)
def test_word_codec_refuses_what_it_does_not_do(changes):
    with pytest.raises(ValueError, match="support|themselves"):
        bpe.WordCodec(altered(WORD_TOKENIZER, **changes))


@pytest.mark.parametrize(
    "changes",
    [
        {"pre_tokenizer__add_prefix_space": True},
        {"normalizer": {"type": "Lowercase"}},
        {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]}},
        {"added_tokens": [SEPARATOR]},
        {"added_tokens": [SEPARATOR | {"lstrip": True}]},
        {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
    ],
)
def test_byte_codec_obeys_the_file(changes):
    text = altered(BYTE_TOKENIZER, **changes)
    codec, library = id_files.ByteCodec(text), Tokenizer.from_str(text)
    library.no_truncation()
    for t in ODD + MIXED + ["12 345 [SEP] x"]:
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


# Id files


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for i in range(200):
        n = int(rng.integers(0, 40_000))
        ids = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) >> rng.integers(0, 64, n).astype(np.uint64)
        if i % 3 == 0:
            ids[rng.random(n) < 0.9] = 0
        if i % 5 == 0:
            ids |= np.uint64(0xF << 60)  # escapes only
        if i % 7 == 0:
            ids &= np.uint64(3)
        payload, offsets = id_files.pack(ids)
        assert (id_files.unpack(payload, offsets) == ids).all()
        if len(offsets) > 1:  # a block by itself
            assert (id_files.unpack_block(payload, int(offsets[1])) == ids[id_files.BLOCK_IDS : 2 * id_files.BLOCK_IDS]).all()


def test_pieces_encode_as_the_library():
    codec = id_files.ByteCodec(open(BYTE_TOKENIZER, encoding="utf-8").read())
    for text in odd_texts():
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == codec.tokenizer.encode(text, add_special_tokens=False).ids


def check_id_files(docs):
    library = Tokenizer.from_file(BYTE_TOKENIZER)
    ids = sorted(
        ((d is not None, d or 0), [*library.encode(t or "", add_special_tokens=False).ids, id_files.END_ID], d) for d, t in texts(docs)
    )
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in id_files.id_file_digests(docs, BYTE_TOKENIZER).collect())
    assert [g[1] for g in got] == [d for *_, d in ids]
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got]).tolist()][: len(got)]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter(g[1:] for g in got) == Counter((d, len(x), crc(x)) for _, x, d in ids)


def test_id_files_documents(documents, monkeypatch):
    monkeypatch.setattr(id_files, "SEGMENT_IDS", 5000)
    check_id_files(documents)


def test_id_files_edge(spark, edge, tmp_path):
    check_id_files(edge)
    assert id_files.id_file_digests(edge.where("false"), BYTE_TOKENIZER).count() == 0
    id_files.write_ids(edge.where("doc_id = 5"), BYTE_TOKENIZER, str(tmp_path / "ids"))
    ids = id_files.read_ids(spark, str(tmp_path / "ids")).first()["ids"]
    assert ids == [*Tokenizer.from_file(BYTE_TOKENIZER).encode("one two").ids, id_files.END_ID]


# Classifiers


@pytest.mark.parametrize("module, label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_classifier_edge(spark, edge, labels, documents, module, label):
    """Learned from the given tables; every row of the documents that go wrong has a score, alike for equal texts."""
    model = module.fitted(documents, labels)
    by_text = {}
    scored = module.scored(edge, model).collect()
    assert len(scored) == edge.count()
    for r in scored:
        assert 0 <= r["score"] <= 1
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert module.predictions(edge.where("false"), labels).count() == 0
    none = module.predictions(edge, labels.where("false")).collect()
    assert {r["score"] for r in none} == ({0.5} if label == "quality" else {0.0})
    odd = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert module.predictions(edge, odd).count() == edge.count()


def test_sample_has_one_row_of_an_id(spark):
    """However many documents and labels share it."""
    docs = spark.createDataFrame([(i % 7, f"text {i % 3}") for i in range(700)] + [(None, "x"), (9, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i % 7, i % 2) for i in range(50)] + [(9, 1), (9, 1)], "doc_id long, quality int")
    found = labelled.training_sample(docs, marks, "quality", {0: 100, 1: 100}).collect()
    held = {i for i in (*range(7), 9) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sorted(r["doc_id"] for r in found) == [i for i in (*range(7), 9) if i not in held]


def test_held_out_rows(documents):
    for r in documents.select("doc_id", labelled.held_out(documents["doc_id"]).alias("held")).collect():
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


@pytest.mark.parametrize("name, label, least", [("op8_quality_model", "quality", 0.9), ("op10_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    found = entries.queries()[name](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    for value in (0, 1):
        some = [r["predicted"] == value for r in found if r[label] == value]
        assert sum(some) >= least * len(some) - 1


def test_chunks_cover_a_document():
    for n in (0, 1, 7, 255, 256, 257, 447, 448, 449, 5000, 5001):
        begins, ends = quality_model.chunk_bounds(n)
        assert begins[0] == 0 and (n == 0 or ends[-1] >= n - 1) and (begins[1:] < ends[:-1]).all()


def test_network_responses_are_convolutions():
    rng = np.random.default_rng(1)
    width, filters = quality_model.WIDTH, quality_model.FILTERS
    weights = rng.normal(size=(width, 256, filters)).astype(np.float32)
    network = quality_model.Network(weights, *[np.zeros(1)] * 5)
    pairs = network.pairs()
    for n in (1, 9, 600, 3001):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        pooled, _ = quality_model.pooled_responses(data, pairs)
        padded = np.frombuffer(data + bytes(3 * width), np.uint8)
        begins, ends = quality_model.chunk_bounds(n)
        for row, (a, b) in zip(pooled, zip(begins, ends, strict=True), strict=True):
            want = np.max([sum(weights[k][padded[i + k]] for k in range(width)) for i in range(a, b, quality_model.STRIDE)], axis=0)
            assert np.allclose(row, want, atol=1e-3)


def test_grammar_marks():
    grammar = toxicity.Grammar({"idio": 5.0, "ass ": 4.0}, [1.0, 0.0, 0.0, 2.0, 3.0, -9.0, -5.0, 0.0])
    marks = lambda text: [dict(zip(toxicity.MARKS, m.tolist(), strict=False)) for c in grammar.clauses(text) for m in grammar.clause_marks(c)]
    assert marks("A calm day. Nothing here") == []
    assert marks("You IDIOTS!") == [{"insult": 5.0, "threat": 0, "targeted": 1, "negated": 0, "reported": 0}]
    assert marks("an idiot, you. Fine")[0]["targeted"] == 1 and marks("calm you. an idiot")[0]["targeted"] == 0
    assert marks("he is not an idiot")[0]["negated"] == 1 and marks("not the one two three idiot")[0]["negated"] == 0
    assert marks('"idiot" ok')[0]["reported"] == 1 and marks("she said idiot")[0]["reported"] == 1 and marks('"x" idiot')[0]["reported"] == 0
    assert marks("classes pass. grass") == [] and marks("an ass.")[0]["insult"] == 4.0 and marks("assess it") == []
    assert marks("I will kill them")[0]["threat"] == 1
    assert grammar.score("I will kill them") > grammar.score("calm") and grammar.score("not an idiot") < grammar.score("an idiot")


# The pipeline


def test_pipeline_stages(spark, sf_dir, documents, labels):
    """Every stage against a plain version on what the one before it kept."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "source_mixing", "bpe_encoding"]
    network = quality_model.fitted(documents, labels)
    pairs = network.pairs()
    docs = documents.collect()
    kept = [r for r in docs if quality_model.score((r["text"] or "").encode(), network, pairs) >= quality_model.ACCEPT]
    one = spark.createDataFrame(stages["quality_classifier"](spark, documents, sf_dir).collect(), documents.schema)
    assert rows(one) == Counter(map(tuple, kept)) and len(kept) < len(docs)

    prints = [(r["doc_id"], plain_print(r["text"])) for r in kept]
    component = plain_components(prints)
    kept = [r for r, (d, p) in zip(kept, prints, strict=True) if component[p] == d]
    two = spark.createDataFrame(stages["simhash_near_dedup"](spark, one, sf_dir).collect(), documents.schema)
    assert rows(two) == Counter(map(tuple, kept))

    split = [(r["text"] or "").encode().split() for r in kept]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(kept, split, strict=True):
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        text = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r["text"]
        want[(r["doc_id"], text, r["lang"], r["source"], len(text) if gone else r["n_chars"])] += 1
    three = spark.createDataFrame(stages["substring_dedup"](spark, two, sf_dir).collect(), documents.schema)
    assert rows(three) == want and any(t[1] != r["text"] for t, r in zip(sorted(want), sorted(kept), strict=True))

    four = spark.createDataFrame(stages["source_mixing"](spark, three, sf_dir).collect(), documents.schema)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(three).collect()}
    words = Counter()
    whole = {r["doc_id"]: r["text"].split() for r in three.collect()}
    for r in four.collect():
        mine = r["text"].split()
        words[r["doc_id"]] += len(mine)
        assert mine == whole[r["doc_id"]][: len(mine)] and mine
    assert words == {d: n for d, n in taken.items() if n}

    check_round_trip(four)
    assert rows(stages["bpe_encoding"](spark, four, sf_dir)) == rows(corpus_pipeline.run(spark, sf_dir))


def test_pipeline_edge(spark, sf_dir, edge):
    """Documents that go wrong, with columns that clash, pass every stage under their own names."""
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        assert made.columns == edge.columns and made.dtypes == edge.dtypes
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        docs = spark.createDataFrame(made.collect(), edge.schema)
        assert docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
