"""Piece encoding, token counts and token files against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from datelore.llm import lengths, pieces, shards
from datelore.llm.charmap import CharacterMap, normalise
from datelore.llm.common import scratch
from datelore.llm.words import WordEncoder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(1)
    letters = "ab .,\n\t▁é日1'<>🙂  ́\r\x1c"
    return ["", " ", "\n", "a  b", "\na", "a\n\nb c", "It's. don't, ok", "a<|endoftext|>b", "▁a b", "<s> </s>", "\x00 a"] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)
    ]


def test_word_ids_are_the_library_s():
    encoder = WordEncoder(BYTES)
    assert encoder.by_words
    for text in odd_texts() * 2:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_piece_ids_and_spans():
    encoder, texts = pieces.PieceEncoder(PIECES), odd_texts()
    assert encoder.by_words
    for _ in range(2):
        packed = encoder.encode_all(texts)
        assert [np.frombuffer(p, "<i4").tolist() for p in packed] == encoder.library.encode(texts)
    flat, counts = np.frombuffer(b"".join(packed), "<i4"), np.array([len(p) // 4 for p in packed])
    begins, ends = encoder.spans_all(texts, flat, counts)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        data = text.encode()
        spans = [(int(a), int(b)) for a, b in zip(begins[at : at + n], ends[at : at + n])]
        assert b"".join(data[a:b] for a, b in spans) == data
        for i, (a, b) in zip(flat[at : at + n].tolist(), spans):
            piece = encoder.library.id_to_piece(i)
            spelt = bytes([int(piece[3:5], 16)]) if encoder.library.is_byte(i) else piece.replace("▁", " ").encode()
            assert data[a:b].replace("▁".encode(), b" ") in (spelt, spelt[1:])
        at += n


def compiled(rules):
    """A double array and its replacements for a few strings, laid out one node after another."""
    trie = {}
    for source in rules:
        node = trie
        for b in source:
            node = node.setdefault(b, {})
        node[None] = source
    units, blob = {}, b""
    place, taken = {}, set()
    for source, target in rules.items():
        place[source] = len(blob)
        blob += target + b"\0"
    def lay(at, node, label):
        # A node's children stand at its offset exclusive-or their byte.
        offset = next(o for o in range(1, 1 << 20) if o not in taken and not any((o ^ b) in units for b in node if b is not None) and o not in units and (at ^ o) < 1 << 21)
        taken.add(offset)
        leaf = None in node
        units[at] = ((at ^ offset) << 10) | (leaf << 8) | label
        if leaf:
            units[offset] = place[node[None]] | 1 << 31
        for b in node:
            if b is not None:
                units[offset ^ b] = 0
        for b, child in node.items():
            if b is not None:
                lay(offset ^ b, child, b)

    lay(0, trie, 0)
    array = np.zeros(-(-(max(units) + 257) // 256) * 256, "<u4")
    for at, unit in units.items():
        array[at] = unit
    return len(array.tobytes()).to_bytes(4, "little") + array.tobytes() + blob


def test_longest_prefix_normalisation_keeps_the_source():
    characters = CharacterMap(compiled({"ﬁ".encode(): b"fi", b"a": b"A", b"ab": b"X", b"abc": b"", "é".encode(): b"e", b"\t": b" "}))
    for text, wanted in {"abd": "▁Xd", "abcd": "▁d", "ﬁn\té": "▁fin▁e", "aab": "▁AX", "": ""}.items():
        spelt, begins, ends = normalise(text, characters)
        assert spelt.decode() == wanted
        assert len(begins) == len(ends) == len(spelt)
    spelt, begins, ends = normalise("xﬁab", characters, dummy_prefix=False)
    assert (spelt, begins.tolist(), ends.tolist()) == (b"xfiX", [0, 1, 1, 4], [1, 4, 4, 6])
    spelt, begins, ends = normalise("  b  c ", CharacterMap(b""), remove_extra=True)
    assert spelt.decode() == "▁b▁c" and begins.tolist() == [2, 2, 2, 2, 3, 3, 3, 5] and ends.tolist()[-2:] == [5, 6]


def test_alignment_of_many_texts_equals_that_of_each():
    texts = odd_texts()
    begin, end, place, sizes = pieces.plain_alignment(texts)
    at = 0
    for text, n in zip(texts, sizes.tolist()):
        spelt, b, e = normalise(text, CharacterMap(b""))
        assert (begin[at : at + n].tolist(), end[at : at + n].tolist()) == (b.tolist(), e.tolist()) and n == len(spelt)
        data = text.encode()
        assert all(data[p] == c for p, c in zip(place[at : at + n].tolist(), spelt) if c < 0x80 and c != 0x20)
        at += n
    assert at == len(begin) == len(end)


def test_spans_through_a_map_that_changes_texts(spark, tmp_path):
    """The model with a map of its own: every piece's source, normalised, is the piece, and the sources cover the text."""
    from sentencepiece import sentencepiece_model_pb2

    rules = {"é".encode(): b"e", "Ａ".encode(): b"A", b"\t": b" ", "ß".encode(): b"ss", b"colour": b"color"}
    model = sentencepiece_model_pb2.ModelProto.FromString(open(PIECES, "rb").read())
    model.normalizer_spec.precompiled_charsmap = compiled(rules)
    path = str(tmp_path / "mapped.model")
    (tmp_path / "mapped.model").write_bytes(model.SerializeToString())
    encoder = pieces.PieceEncoder(path)
    texts = ["café au lait", "Ａ colour\tof the sea", "plain words", "", "日é", "the colourful\ntéé"]
    found = pieces.encode_pieces(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), path).collect()
    assert len(found) == len(texts) and not encoder.plain
    for r in found:
        assert r["ids"] == encoder.library.encode(r["text"])
        data, at = r["text"].encode(), 0
        for k, (i, a, b) in enumerate(zip(r["ids"], r["begins"], r["ends"])):
            assert a == at and b >= a
            at = b
            piece = encoder.library.id_to_piece(i)
            if encoder.library.is_byte(i):
                assert data[a:b] == bytes([int(piece[3:5], 16)])
                continue
            spelt, _, _ = normalise(data[a:b].decode(), encoder.characters, dummy_prefix=False)
            assert spelt == (piece[1:] if k == 0 else piece).encode()
        assert at == len(data)
    assert any(r["ends"][k] - r["begins"][k] != len(encoder.library.id_to_piece(i).encode()) for r in found for k, i in enumerate(r["ids"]))


def test_query_s_spans_equal_plain_ones(spark, sample):
    import hashlib

    from datelore.llm.queries import QUERIES

    encoder = pieces.PieceEncoder(PIECES)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    for r in QUERIES["op4_sentencepiece"](spark, sample).collect():
        begins, ends = encoder.aligned(texts[r["doc_id"]], encoder.library.encode(texts[r["doc_id"]]))
        assert r["spans_sha256"] == hashlib.sha256(",".join(map(str, [*begins.tolist(), *ends.tolist()])).encode()).hexdigest()


def test_encoding_and_decoding_tables(odd, rows, nothing):
    library = pieces.PieceEncoder(PIECES).library
    found = pieces.encode_and_decode(odd, PIECES).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["ids"]) for r in found) == sorted((i or -1, t or "", library.encode(t or "")) for i, t, _, _ in rows)
    assert all(r["decoded"] == library.decode(r["ids"]) for r in found)
    apart = pieces.decode_pieces(pieces.encode_pieces(odd, PIECES), PIECES)
    assert apart.select("doc_id", "ids", "decoded").exceptAll(pieces.encode_and_decode(odd, PIECES).select("doc_id", "ids", "decoded")).count() == 0
    assert pieces.encode_pieces(nothing, PIECES).count() == 0
    missing = pieces.decode_pieces(odd.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), PIECES)
    assert {r["decoded"] for r in missing.collect()} == {""}


def test_lengths_answer_every_limit(odd, rows, nothing, monkeypatch):
    monkeypatch.setattr(lengths, "SPAN", 8)
    encoder = WordEncoder(BYTES)
    for by, group in ((), lambda r: ()), (("source",), lambda r: (r[3],)):
        counts = {}
        for r in rows:
            counts.setdefault(group(r), []).append(len(encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids))
        sums = lengths.suffix_sums(lengths.length_histogram(lengths.token_counts(odd, BYTES), by), by)
        found = {tuple(r) for r in sums.select(*by, "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "truncated_tokens", "total_docs", "total_tokens").collect()}
        wanted = {
            (*g, n, own.count(n), sum(x >= n for x in own), sum(x for x in own if x >= n), sum(min(x, n) for x in own), len(own), sum(own)) for g, own in counts.items() for n in own
        }
        assert found == wanted
        limits = [0, 1, 7, 100, 10**6]
        totals = {tuple(r) for r in lengths.truncated_totals(sums, limits, by).collect()}
        assert totals == {(*g, n, sum(min(x, n) for x in own), sum(x > n for x in own)) for g, own in counts.items() for n in limits}
        shares = {tuple(r) for r in lengths.length_quantiles(sums, [0.25, 0.5, 1.0], by).collect()}
        assert shares == {(*g, p, min(n for n in own if sum(x <= n for x in own) / len(own) >= p)) for g, own in counts.items() for p in (0.25, 0.5, 1.0)}
    assert lengths.suffix_sums(lengths.length_histogram(lengths.token_counts(nothing, BYTES))).count() == 0


def test_token_files_read_back(spark, odd, rows, nothing):
    encoder = WordEncoder(BYTES)
    target = scratch(spark, "tokens")
    table = shards.write_token_shards(odd, target, BYTES, end_id=2)
    found = [(r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in shards.read_token_shards(table, target).orderBy("start").collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    wanted, start = [], 0
    for i, text, _, _ in ordered:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        wanted.append((i, start, len(ids), ids))
        start += len(ids)
    assert found == wanted
    whole = b"".join(np.array(w[3], "<u2").tobytes() for w in wanted)
    files, path = shards.file_system(target)
    read = b"".join(files.open_input_file(f"{path}/{r['name']}.tokens").read() for r in table.orderBy("shard").collect())
    assert zlib.crc32(read) == zlib.crc32(whole)
    empty = scratch(spark, "tokens")
    assert shards.read_token_shards(shards.write_token_shards(nothing, empty, BYTES), empty).count() == 0
