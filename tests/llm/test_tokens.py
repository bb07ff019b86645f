"""Token counts, token files and packing against the libraries over whole texts."""

import collections
import zlib

import numpy as np
import pytest

from shelfmark.llm.encoding import Encoder, tokenizer_path
from shelfmark.llm.packing import pack
from shelfmark.llm.token_counts import token_counts
from shelfmark.llm.token_files import pack_bits, read_ids, read_token_files, unpack_bits, write_token_files
from shelfmark.session import work_dir

BYTE, WORD, PIECE = (tokenizer_path(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def whole(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return [model.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
@pytest.mark.parametrize("most", [5, 10000])
def test_encoder_equals_library(odd_texts, path, most):
    import pyarrow as pa

    encoder = Encoder(path, most)
    for part in (odd_texts, odd_texts[:40], []):
        ids, offsets = encoder.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == whole(path, part)


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
@pytest.mark.parametrize("table_size", [0, 20, 1000])
def test_counts(odd_docs, path, table_size):
    rows = odd_docs.select("doc_id", "text").collect()
    got = token_counts(odd_docs, path, limit=10, table_size=table_size, per_task=50).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(ids), len(ids) > 10) for r, ids in zip(rows, whole(path, [r.text for r in rows]), strict=True)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_counts_of_nothing(no_docs):
    assert token_counts(no_docs, PIECE).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 31, 32])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = pack_bits(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    for start, count in ((0, 1001), (0, 0), (1, 1), (37, 500), (1000, 1)):
        assert unpack_bits(packed, bits, start, count).tolist() == ids[start: start + count].tolist()


@pytest.mark.parametrize("path,bits", [(BYTE, 16), (PIECE, 15)])
def test_files_round_trip(spark, odd_docs, path, bits):
    folder = work_dir(spark, "test-files")
    write_token_files(odd_docs, path, folder, end_id=0, block=500)
    assert {r.bits for r in spark.read.parquet(folder).select("bits").distinct().collect()} == {bits}
    rows = odd_docs.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    got = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.start)
    start = 0
    assert len(got) == len(rows)
    for row, mine, ids in zip(rows, got, whole(path, [r.text for r in rows]), strict=True):
        ids = [*ids, 0]
        assert (mine.doc_id, mine.start, mine.n_tokens, mine.ids_crc32, mine.ids) == (row.doc_id, start, len(ids), crc(ids), ids)
        start += len(ids)
    last = max(rows, key=lambda r: len(r.text or "")).doc_id
    ids = [*whole(path, [next(r.text for r in rows if r.doc_id == last)])[0], 0]
    assert read_ids(spark, folder, last, 12345, 700).tolist() == ids[12345:13045]


def test_files_of_nothing(spark, no_docs):
    folder = work_dir(spark, "test-files")
    write_token_files(no_docs, BYTE, folder, end_id=0)
    assert read_token_files(spark, folder).count() == 0


@pytest.mark.parametrize("length,windows", [(16, 2), (64, 8), (4096, 64)])
def test_packing(odd_docs, length, windows):
    rows = odd_docs.select("doc_id", "text").collect()
    got = pack(odd_docs, WORD, end_id=2, length=length, windows=windows).collect()
    want = collections.defaultdict(list)
    for row, ids in zip(rows, whole(WORD, [r.text for r in rows]), strict=True):
        want[row.doc_id].append([*ids, 2])
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == crc(r.ids)
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, documents in want.items():
        mine = sorted(pieces.pop(doc), key=lambda r: r.start)
        assert sum(r.length for r in mine) == sum(map(len, documents))
        if len(documents) == 1:
            assert [i for r in mine for i in r.ids] == documents[0]
            assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
            assert {r.doc_tokens for r in mine} == {len(documents[0])}
    assert not pieces
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    total = sum(len(d) for documents in want.values() for d in documents)
    assert len(sequences) * length <= total * 1.1 + length


def test_packing_of_nothing(no_docs):
    assert pack(no_docs, WORD, end_id=2).count() == 0


def test_ids_of_absent_and_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "three"), (4, "")], "doc_id long, text string")
    folder = work_dir(spark, "test-files")
    write_token_files(docs, BYTE, folder, end_id=0)
    assert read_ids(spark, folder, 2).tolist() == [] and read_ids(spark, folder, 4).tolist() == [0]
    assert read_ids(spark, folder, 1).tolist() == [*whole(BYTE, ["one two"])[0], 0]
    assert read_ids(spark, folder, 1, start=1, count=1).tolist() == whole(BYTE, ["one two"])[0][1:2]


def test_encoder_on_pieces_of_every_kind():
    import random

    import pyarrow as pa

    rng = random.Random(8)
    parts = [" ", "\n", "\n\n", "\r\n", "\t", "a", "B", "é", "É", "×", "÷", "à,", "ab.", "<|endoftext|>", "<|EndOfText|>", "1", "23", "'s", "'S", "!", "...", "_", "́",
             "\x00", "\x1f", "\x85", "\xa0", "İ", "ß", "’", '"', "%", "º", "Ã", "x" * 70, "y" * 63]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for path in (BYTE, WORD):
        encoder = Encoder(path, 40)                                   # the table overflows again and again
        for start in range(0, 3000, 700):
            part = texts[start: start + 700]
            ids, offsets = encoder.encode(pa.array(part))
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == whole(path, part)
