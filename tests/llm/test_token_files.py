import time
import zlib

import numpy as np
import pytest

from shelfspark.llm import range_coder, token_files


@pytest.mark.parametrize("ids", [[], [0], [65535] * 300, list(range(200)), [7, 8, 9] * 400])
def test_blocks_come_back(ids):
    blocks = range_coder.encode_blocks(np.array(ids, np.int64), 64)
    lengths = [min(64, len(ids) - 64 * i) for i in range(len(blocks))]
    assert np.concatenate([np.empty(0), *range_coder.decode_blocks(blocks, lengths)]).tolist() == ids


def test_random_ids_and_single_blocks_come_back():
    random = np.random.default_rng(3)
    ids = np.r_[random.integers(0, 65536, 700), random.zipf(1.3, 3000) % 50000]
    blocks = range_coder.encode_blocks(ids, 500)
    lengths = [500] * 7 + [200]
    assert (np.concatenate(range_coder.decode_blocks(blocks, lengths)) == ids).all()
    assert (range_coder.decode_blocks([blocks[5]], [500])[0] == ids[2500:3000]).all()  # a block needs no other
    assert [len(x) for x in range_coder.decode_blocks([b"", b"\x00\x01junk"], [3, 9])] == [3, 9]
    with pytest.raises(ValueError):
        range_coder.encode_blocks(np.array([1 << 16]))


def test_repeated_phrases_take_few_bits():
    phrase = np.random.default_rng(1).integers(0, 49000, 40)
    size = sum(map(len, range_coder.encode_blocks(np.tile(phrase, 100))))
    assert size < 4000 * 2 / 8  # eight times smaller than 16 bits an id


TEXTS = ["", " ", "Hello, World's 123  \n\n IT'S we'll", "''s !'s 'st", "a" * 3000, "éß中文 Σας \U0001f600‍\U0001f600", "<|endoftext|> x <|startoftext|>", "tab\there \u0085 　 end ", "Word " * 4000, "é İ ǅ"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    letters = [f"a{chr(c)}B {chr(c)}{chr(c)}1" for c in range(0x300)]
    got = token_files.encode_texts(token_files.public_spec(), TEXTS + letters)
    for text, ids in zip(TEXTS + letters, got, strict=True):
        assert ids.tolist() == library(text), repr(text)


def test_files_hold_all_documents_in_order(make, library, tmp_path):
    docs = make(*((100 - i, t) for i, t in enumerate(TEXTS)), (None, "null id"), (5, None), (5, "twice"), (5, "twice"))
    encoded = token_files.encode(docs.repartition(3), token_files.public_spec(), end_id=1)
    manifest = token_files.write_files(encoded, f"file://{tmp_path}/out", file_ids=300, block=64)
    files = manifest.collect()
    assert len(files) > 2 and sum(f["documents"] for f in files) == len(TEXTS) + 4
    rows = sorted(token_files.read_files(manifest, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 5, 5, 5, *range(91, 101)]
    texts = {100 - i: t for i, t in enumerate(TEXTS)}
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
        if r["doc_id"] in texts:
            assert r["ids"] == library(texts[r["doc_id"]]) + [1]
    assert sorted(tuple(r["ids"]) for r in rows[1:4]) == sorted([(1,), tuple(library("twice")) + (1,)] + [tuple(library("twice")) + (1,)])


def test_documents_without_ids_and_empty_tables(make, tmp_path):
    spec = token_files.public_spec()
    rows = token_files.read_files(token_files.write_files(token_files.encode(make((1, ""), (2, None), (3, "x")), spec))).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows)[:2] == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert token_files.read_files(token_files.write_files(token_files.encode(make(), spec))).count() == 0


def test_damage_is_named(make, tmp_path):
    encoded = token_files.encode(make((1, "some words to damage"), (2, "more")), token_files.public_spec())
    (file,) = token_files.write_files(encoded, f"file://{tmp_path}/out").collect()
    path = file["file"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[0] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match=r"blocks \[0\]"):
        list(token_files.ids_of_file(file["file"]))
    data[-30] ^= 1
    open(path, "wb").write(data[:-1])
    with pytest.raises(ValueError, match="not a file"):
        list(token_files.ids_of_file(file["file"]))


def test_coding_costs_little():
    """A million ids both ways take less than 54 million steps of a plain sum; the coder that learned at every id took 65 or more."""

    def least(run):
        took = []
        for _ in range(3):
            at = time.process_time()
            run()
            took.append(time.process_time() - at)
        return min(took)

    ids = np.random.default_rng(5).zipf(1.3, 1_000_000) % 40_000
    both = lambda: range_coder.decode_blocks(range_coder.encode_blocks(ids, 1024), [1024] * 976 + [576])
    assert least(both) < 18 * least(lambda: sum(range(3_000_000)))


def test_blocks_have_a_longest_size():
    with pytest.raises(ValueError, match="1 to 4096"):
        range_coder.encode_blocks(np.arange(5000), 4097)


def test_remembered_fields_equal_the_library(library):
    texts = ["The (the) 'the' the's", "THE the, the.\x1cthe \x1d", "x\x00y \x7f\u00a0\x85z", "l'\u00e9t\u00e9, \u00e9t\u00e9\u2019s"]
    for _ in range(2):  # the second time all fields are known
        got = list(token_files.encode_texts(token_files.public_spec(), texts * 2))
        assert [g.tolist() for g in got] == [library(t) for t in texts * 2]


@pytest.mark.parametrize("block", [17, 1023, 3073, 4096])
def test_few_and_odd_ids_come_back_from_blocks_of_all_lengths(block):
    random = np.random.default_rng(36)
    noisy = np.where(random.random(14_000) < 0.1, random.integers(0, 65536, 14_000), np.tile(random.integers(0, 65536, 150), 94)[:14_000])
    for ids in (random.integers(0, 2, 14_000), random.integers(0, 3, 14_000), noisy, np.zeros(14_000, np.int64)):
        blocks = range_coder.encode_blocks(ids, block)
        lengths = [min(block, 14_000 - block * i) for i in range(len(blocks))]
        assert (np.concatenate(range_coder.decode_blocks(blocks, lengths)) == ids).all()
