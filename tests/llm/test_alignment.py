import hashlib
import random
from collections import Counter

import pytest

from recon.llm.alignment import Sides, alignment_figures, alignments, byte_bpe, piece_bpe
from recon.llm.wordids import _byte_alphabet

SCHEMA = "doc_id bigint, text string, row string, pair string, n string"


class Slow:
    """Whole texts by both libraries, links by all pairs of tokens."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe())
        self.bytes_of = {c: b for b, c in _byte_alphabet().items()}

    def tokens(self, text):
        a = [(i, bytes(self.bytes_of[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        return a, b

    def aligned(self, text):
        if not text:
            return [], [], []
        a, b = self.tokens(text)
        if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            return [], [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, at = [], 0
        for end in ends:
            groups.append(tuple([str(i) for s, e, i in side if at <= s and e <= end] for side in spans))
            at = end
        return links, groups, spans


def slow(rows):
    s = Slow()
    each = [(d, *s.aligned(t)) for d, t in rows]
    count = Counter(x for _, links, _, _ in each for x in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for d, links, groups, spans in each:
        text = ";".join(f"{','.join(a)}|{','.join(b)}" for a, b in groups)
        n_a, n_b = (len(x) for x in spans) if spans else (0, 0)
        out.append((d, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["the", "The", "ing", "Eauouon.", "naïve", "日本語", "x1y2", "it's", "<|endoftext|>", "</s>", "<0x41>", "😀", " ", "ﬁ", "á", "1234567", "...", "\x00", "if(x){", " "]
    out = [(i, rng.choice([" ", " ", " ", "\n", ". ", "  "]).join(rng.choices(words, k=rng.choice([1, 2, 5, 40])))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " "), (103, "   "), (104, " x"), (105, "x "), (106, "a ▁ b"), (107, "▁"), (108, "a\n \n b"), (109, "\t"), (110, "x" * 3000), (None, "the ing"), (5, "the the"), (5, "the the")]
    return out


def test_figures_against_whole_texts_and_all_pairs(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA).repartition(3)
    want = sorted(slow(rows), key=repr)
    assert sorted(map(tuple, alignment_figures(docs).collect()), key=repr) == want
    assert sorted(map(tuple, alignment_figures(docs, part=50).collect()), key=repr) == want
    assert alignment_figures(spark.createDataFrame([], SCHEMA)).collect() == []


def test_alignments_in_full(spark, rows):
    s = Slow()
    for r in alignments(spark.createDataFrame([(d, t) for d, t in rows if d not in (None, 5)], "doc_id bigint, text string"), byte_bpe(), piece_bpe()).collect():
        links, groups, spans = s.aligned(dict(rows)[r.doc_id])
        assert sorted((r.a_ids[i], r.b_ids[j]) for i, j in zip(r.links_a, r.links_b)) == sorted(links)
        assert len(r.a_ends) == len(r.b_ends) == len(groups)
        assert [len(a) for a, _ in groups] == [z - a for a, z in zip([0, *r.a_ends], r.a_ends)] and [len(b) for _, b in groups] == [z - a for a, z in zip([0, *r.b_ends], r.b_ends)]
        assert (r.a_ids, r.b_ids) == tuple([x[2] for x in side] for side in spans or ([], []))


def test_words_of_a_full_cache_are_still_right():
    few, many = Sides(byte_bpe(), piece_bpe(), room=3), Sides(byte_bpe(), piece_bpe())
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join(str(rng.randrange(30)) for _ in range(20))
        assert few.encode(text) == many.encode(text)
    assert len(few.words) <= 3


def test_vocabulary_of_a_is_in_the_order_of_its_merges():
    import json

    with open(byte_bpe(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    assert all(model["vocab"]["".join(x)] == 256 + k for k, x in enumerate(model["merges"]))
