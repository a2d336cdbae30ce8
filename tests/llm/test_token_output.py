import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from recon.llm import rans
from recon.llm.common import Kept
from recon.llm.token_output import encoded_digest, read_files, word_bpe, write_files
from recon.llm.wordids import WordIds

SCHEMA = "doc_id bigint, text string, start string, ids string"
ODD = ["", None, " \n\t", "It's  Über-Größe x ﬁ ΑΣ ΟΔΟΣ é<|endoftext|>b 12.5 km", "<|startoftext|> a", "ß" * 300, "né né", "x" * 5000, "日本語 テキスト 🙂🙂", "don't can't 'Tis"]


def test_words_are_encoded_as_whole_texts_are():
    tokenizer, own = Tokenizer.from_file(word_bpe()), WordIds(word_bpe(), room=50)
    rng = random.Random(3)
    pool = ["über", "The", "it's", "end.", "A1b2", "ÀÉ!!", "(x)", "|", "a|b", "İstanbul", "étude", "1,000.5", "foo bar", "ﬂ", "'s", "x's.", "<|endoftext|>", "\x1c", "a\x85b", "ª", "STRASSE&&&"]
    texts = [t for t in ODD if t] + [rng.choice([" ", "\n", "  ", "\t"]).join(rng.choices(pool, k=40)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("n,lanes,every", [(0, 4, 2), (1, 8, 2), (7, 8, 2), (1000, 8, 4), (5000, 512, 3)])
def test_blocks_round_trip_and_segments_alone(n, lanes, every):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint16)
    counts = {int(s): int(c) for s, c in zip(*np.unique(np.append(ids, 5), return_counts=True))}
    table = rans.Table.fit(counts, 12)
    assert table.freq.sum() == 1 << 12
    lengths = np.array([n // 3, n - n // 3])
    block = rans.encode(ids, np.array([4, rans.NULL]), lengths, table, lanes, every)
    docs, sizes, back = rans.decode(block, table)
    assert docs.tolist() == [4, rans.NULL] and sizes.tolist() == lengths.tolist() and (back == ids).all()
    if n > lanes * every:
        assert (rans.decode(block, table, only=1)[2] == ids[lanes * every:2 * lanes * every]).all()
    if n:
        broken = bytearray(block)
        broken[-9] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(broken), table)
        with pytest.raises(ValueError):
            rans.decode(block, rans.Table.fit({1: 1, 2: 5}, 12))


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(word_bpe()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_document(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**9), " ".join(rng.choices(["alpha", "Beta,", "naïve", "42", "x!"], k=rng.randrange(300)))) for _ in range(120)]
    rows += list(enumerate(ODD)) + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], SCHEMA)
    got = encoded_digest(docs)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows)
    folder = Kept(spark, "t").root
    write_files(docs, folder, word_bpe(), block_ids=500)
    small = {(r.doc_id, r.start): r for r in read_files(spark, folder).collect()}
    assert [(i, s, small[i, s].n_tokens, small[i, s].ids_crc32) for i, s, _, _ in expected(rows)] == expected(rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in small.values())
    assert spark.read.parquet(f"{folder}/blocks").count() > 5


def test_empty_table_and_repeated_rows(spark):
    assert encoded_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    got = encoded_digest(spark.createDataFrame([(3, "a b", None, None)] * 2, SCHEMA)).collect()
    assert sorted(r.start for r in got) == [0, 3]
