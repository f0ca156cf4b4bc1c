"""What the encoder does with blocks of texts: ids as of whole texts, and how often words are encoded."""

import random

import pyarrow as pa

from proseline.llm import packing

ODD = [
    "", " ", "\n", "a ", "\na", " a", "a  b", "a \n b", "a\n\nb", "a\tb c", "a\r\nb", "a\x0b b", "x \x1cy", "a 　b", "a　 b", "a\x85 b",
    "a  <|endoftext|> b", "a\t\n<|endoftext|>", "it's, don't. 'tis", "x). y),", "1,000, 2.5.", "², ٣. Ⅷ!", "é, é,", "a" * 70 + ", b",
]
USUAL = ["One line, and\nAnother one. And, one! more", "café, naïve.\nÉtat 中文。 \U0001f600!", "end"]


def test_ids_of_a_block_are_those_of_whole_texts(monkeypatch):
    draw = random.Random(3)
    parts = [" ", " ", " ", "\n", *ODD, *USUAL]
    texts = [*ODD, *USUAL, *("".join(draw.choices(parts, k=draw.randrange(1, 6))) for _ in range(400))]
    for remembered in (packing.REMEMBERED, 6):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        encoder = packing.Encoder(packing.default_vocabulary())
        for i in range(0, len(texts), 100):
            own = texts[i : i + 100]
            assert encoder.many(own) == [encoder.ids(x) for x in own]


def test_a_word_is_remembered_without_the_marks_that_end_it():
    encoder = packing.Encoder(packing.default_vocabulary())
    encoder.many(["a word, word. word!\nword: word", "a word,,"])
    assert set(encoder.known) == {"\na", "word", "\nword"}


def test_words_of_the_texts_before_are_still_known_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 8)
    encoder, learned = packing.Encoder(packing.default_vocabulary()), []
    letters = encoder.letters
    monkeypatch.setattr(encoder, "letters", lambda word: learned.append(word) or letters(word))
    first, second, third = ({f"{x}{y}" for y in "abc"} for x in "uvw")
    for words in (first, second, third, second):
        encoder.learn(words)
    assert sorted(learned) == sorted(first | second | third)


def test_small_batches_become_one_block_and_large_ones_several():
    def batch(ids, size):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([b"\xff" + b"a" * size] * len(ids), pa.binary())], names=["doc_id", "body"])

    batches = [batch(range(10), 9), batch([], 9), batch(range(10, 1000), 9), batch([1000], 99)]
    found = list(packing.blocks(batches, 5000))
    assert [x for ids, _ in found for x in ids.to_pylist()] == list(range(1001))
    assert [len(ids) for ids, _ in found] == [522, 479]
    assert found[-1][1][-1].as_py() == "�" + "a" * 99
    assert list(packing.blocks([batch([], 1)])) == []
