"""What a Python worker holds after its task: workers live on beside the stages that follow."""

import tracemalloc

import numpy as np

from fossilframe.llm import decontaminate, pieces
from fossilframe.llm.common import hash_text
from fossilframe.llm.queries import tokenizer_path


def test_automata_of_earlier_calls_go():
    items = [("a", ["one", "two", "three"])]
    decontaminate._BUILT.clear()
    for token in ("first", "second", "third"):
        a = decontaminate._automaton((token, 0), items, 2)
        assert a.scan(["one", "two", "other"])[1]
    assert [k[0] for k in decontaminate._BUILT] == ["third"]
    assert a.cache
    decontaminate._forget()
    assert not a.cache and a.scan(["one", "two"])[1]


def test_codec_forgets_words():
    c = pieces.PieceCodec(tokenizer_path())
    ids = c.encode("some words, words again")
    c.digest("some words, words again")
    assert c.words or c.parts or c.pairs
    c.forget()
    assert not (c.words or c.parts or c.pairs) and c.encode("some words, words again") == ids


def test_automaton_remembers_few_words():
    a = decontaminate.SuffixAutomaton([("a", ["one", "two", "three"])], 2)
    for k in range(60):
        assert a.scan([*(f"w{k}x{i}" for i in range(1000)), "One", "TWO"]) == ([(1000, 1002)], {"a"})
    assert len(a.cache) < 25_000
    decontaminate._BUILT[("token", 0)] = a
    decontaminate._forget()
    assert not decontaminate._BUILT


def test_hashing_takes_bounded_memory():
    """Beside its results, which are 24 bytes a word."""
    buffer = np.frombuffer(b"somewhat-long-words-here " * 160_000, np.uint8)
    tracemalloc.start()
    hash_text(buffer, np.array([0, len(buffer)]), False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 << 20
