import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from anonframe.llm.packing import Words, pack_documents, plan
from tokenizers import Tokenizer

from .fixtures import documents, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_piece_by_piece_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    room, placed = {}, {x: set() for x in histogram}
    for (length, rank, first, each, offset), nxt in zip(r := plan(histogram, capacity), [*r[1:], None], strict=True):
        end = nxt[1] if nxt and nxt[0] == length else histogram[length]
        for t in range(rank, end):
            placed[length].add(t)
            b = first + (t - rank) // each
            assert offset + (t - rank) % each * length == capacity - room.get(b, capacity)
            room[b] = room.get(b, capacity) - length
    assert all(len(placed[x]) == n for x, n in histogram.items())
    assert sorted(room.values()) == best_fit_decreasing(lengths, capacity)


def test_pieces_and_places(spark, sf):
    docs = documents(spark, sf).unionByName(spark.createDataFrame([(20_000, "a<|endoftext|>b \x1c\x85 c d é ́")], "doc_id long, text string"), allowMissingColumns=True)
    out = pack_documents(docs, PATH).toPandas()
    coder = Tokenizer.from_file(PATH)
    want = {}
    for i, t in rows(docs):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            want[i, p] = (a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert out.sequence_id.nunique() == len(best_fit_decreasing([x[1] for x in want.values()], 2048))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_equal_the_tokenizer():
    coder = Tokenizer.from_file(PATH)
    words = Words(coder, 1 << 14)  # generations change often
    assert words.by_word
    rng = random.Random(2)
    marks = list("abcXYZ'  \t\n\x0b.,;-_<>|!\"#09éÉßÿÀ×÷øİſﬁ́中🙂\x85\x1c\xa0“’¿²ªº")
    some = ["don't", "'tis", "<|endoftext|>", "<|", "it'S", "'re", "x'd", "1'm", "ÉCOLE", "naïve"]
    for _ in range(4000):
        text = "".join(rng.choice(marks) if rng.random() < 0.7 else rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids, text
    assert words.size <= words.limit


def test_another_vocabulary_gets_whole_texts():
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = Words(coder)
    assert not words.by_word
    for text in ("Hello World, it's  1999", "", "À la\nune"):
        assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids
