"""Hashes of byte ranges and the word tokenizer against Python's own bytes and the tokenizer itself."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tabulon.llm import op6_packing
from tabulon.llm.op6_packing import Words
from tabulon.llm.textkernels import Texts, blocks_of, same_bytes

rng = random.Random(4)


def thue_morse(n: int) -> tuple[str, str]:
    """The word of n letters a and b, and its complement; sums of place values cannot tell the two apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_tell_words_apart():
    words = sorted({"".join(rng.choices("abé ß", k=rng.randint(1, 30))).replace(" ", "x") for _ in range(5000)} | {w for n in (8, 64, 512, 1024, 2048, 4096) for w in thue_morse(n)})
    t = Texts(pa.array([" ".join(words), None, "", " ".join(reversed(words))]))
    start, end, first = t.words()
    h = t.hashes(start, end)
    n = len(words)
    assert first.tolist() == [0, n, n, n, 2 * n]
    assert len(set(h[:n].tolist())) == n and h[:n].tolist() == h[n:][::-1].tolist()


def test_same_bytes():
    a, b = b"abcdefgh-abcdefghi", b"xabcdefgh_abcdefghi"
    at, to, size = np.array([0, 9, 0, 0, 8]), np.array([1, 10, 1, 2, 9]), np.array([8, 9, 9, 0, 1])
    want = [a[i : i + n] == b[j : j + n] for i, j, n in zip(at, to, size, strict=True)]
    assert same_bytes(blocks_of(np.frombuffer(a, np.uint8)), at, blocks_of(np.frombuffer(b, np.uint8)), to, size).tolist() == want


def test_words_are_compared_by_bytes(monkeypatch):
    import public_tokenizers

    words = Words(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(thue_morse(n)) for n in (1024, 2048, 4096)] + ["".join(rng.choices("abcdeé \n", k=400)) for _ in range(40)] + ["", "a\x01b \x01 c", "one two", "two three one"]
    want = [words.tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]

    def got():
        ids, marks = words.encode(Texts(pa.array(texts)))
        return [ids[a:z].tolist() for a, z in zip(marks[:-1], marks[1:], strict=True)]

    assert got() == want and got() == want  # new words, then remembered ones
    # All words share few hashes: the bytes still decide.
    plain = Texts.hashes
    monkeypatch.setattr(op6_packing.Texts, "hashes", lambda self, s, e: plain(self, s, e) % np.uint64(7))
    words.clear()
    assert got() == want and got() == want
