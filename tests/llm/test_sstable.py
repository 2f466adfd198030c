import json
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from rows import SCHEMA, document
from tokenizers import Tokenizer

from weftline.llm import sstable
from weftline.llm.scratch import Scratch
from weftline.llm.sstable import BLOCK_BYTES, ShardReader, ShardWriter, key_of, lookup, make_manifest, token_shards, write_shards
from weftline.llm.tokenizing import WordTokenizer, word_bpe_path


def test_words_give_the_library_ids():
    library, own = Tokenizer.from_file(word_bpe_path()), WordTokenizer(open(word_bpe_path()).read())
    for text in ("", "Hello  World's\tend", "café café  x İΣ \U0001f600!!", "<|endoftext|> a<|endoftext|>b", "it's 123abc ,. 'll"):
        assert np.frombuffer(own.encode(text.encode()), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_shards_give_back_what_was_written(spark, tricky):
    scratch = Scratch(spark, "test")
    got = sorted(token_shards(tricky, scratch=scratch, shard_text_bytes=20000).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(word_bpe_path()), 0
    ids_of = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(repr((r.doc_id, len(x), crc(x))) for r in tricky.collect() for x in [ids_of(r.text)])
    make_manifest(spark, scratch.path("shards"), scratch.path("manifest"))
    found = sorted(((r.doc_id, r.ids) for r in lookup(spark, scratch.path("manifest"), [1, 10, None, 12345]).collect()), key=repr)
    assert found == sorted(((r.doc_id, ids_of(r.text)) for r in tricky.collect() if r.doc_id in (1, 10, None)), key=repr)


def test_lookup_reads_few_bytes(spark):
    rng, scratch = random.Random(2), Scratch(spark, "test")
    docs = spark.createDataFrame([document(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(2000)], SCHEMA)
    write_shards(docs, scratch.path("shards"), shard_text_bytes=1 << 20)
    make_manifest(spark, scratch.path("shards"), scratch.path("manifest"))
    files = spark.read.parquet(scratch.path("manifest")).collect()
    assert len(files) >= 4 and sum(f.entries for f in files) == 2000
    rows = lookup(spark, scratch.path("manifest"), [7, 1234, 99999]).collect()
    assert sorted(r.doc_id for r in rows) == [7, 1234]
    assert all(r.bytes_read < 3 * BLOCK_BYTES for r in rows) and sum(r.bytes_read for r in rows) < 0.1 * sum(f.size for f in files)


def test_other_definitions_take_whole_texts():
    definition = json.loads(open(word_bpe_path()).read())
    del definition["normalizer"]["normalizers"][2]  # no longer lower-cases
    changed = json.dumps(definition)
    own, library = WordTokenizer(changed), Tokenizer.from_str(changed)
    assert not own.by_word and WordTokenizer(open(word_bpe_path()).read()).by_word
    for text in ("Hello  World's\tend", "ABC ABC abc"):
        assert np.frombuffer(own.encode(text.encode()), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_lookup_in_one_shard_and_damage():
    writer, data = ShardWriter(0, 2, block_bytes=100), b""
    for i in [None, *range(-50, 50), 49, 49]:
        for frame in writer.add(key_of(i), np.full((i or 0) % 5, 7, "<u2").tobytes() + b"\x02\x00"):
            data += frame + b"\n"
    for frame in writer.finish():
        data += frame + b"\n"
    reader = ShardReader.of(data)
    assert [len(reader.get(i)) for i in (None, -50, 0, 49, 50, -51)] == [1, 1, 1, 3, 0, 0]
    assert [d for d, _ in reader.scan()] == [None, *range(-50, 50), 49, 49]
    with pytest.raises(ValueError):
        list(ShardReader.of(data[:10] + b"#" + data[11:]).scan())


def test_empty_table(empty):
    assert token_shards(empty).collect() == []


def test_texts_encoded_together_are_as_texts_encoded_alone():
    tokenizer = WordTokenizer(Path(word_bpe_path()).read_text())
    texts = ["", " \t\n\x0b\x0c\r ", "one two, two! ONE", "Élan café naïve ﬁne", "a b c d", "it's 12 o'clock | ## x_y", "\U0001f600 \x00 \x1c q", " lead and trail ", "wörter " * 500]
    for own in (tokenizer, WordTokenizer(Path(word_bpe_path()).read_text(), by_word=False)):
        for rows in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array([], pa.string())):
            ids, begins = own.encode_all(rows)
            alone = [own.library.encode(t, add_special_tokens=False).ids for t in rows.to_pylist()]
            assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == alone


def test_pieces_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["aaaa", "", "bb", "c" * 50, "", "d", "e" * 9])], ["doc_id", "text"])
    for size in (1, 5, 60, 1000):
        parts = list(sstable.pieces(batch, size))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(7))
    assert [p.num_rows for p in sstable.pieces(batch, 6)] == [3, 1, 3] and list(sstable.pieces(batch.slice(0, 0), 5)) == []
