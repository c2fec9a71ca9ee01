"""Wavelet matrix and token files: exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quire.llm import token_files, wavelet

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,top,levels", [(0, 1, 16), (1, 3, 2), (300_000, 50_257, 16), (5000, 70_000, 17), (4000, 2, 1)])
def test_wavelet_round_trip(n, top, levels):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
    w = wavelet.WaveletMatrix(wavelet.build(ids, levels))
    assert len(w) == n and (w.decode() == ids).all()
    for i in rng.integers(0, n, min(n, 40)).tolist():
        token = int(ids[i])
        assert w.access(i) == token
        assert w.count(token, i) == int((ids[:i] == token).sum()) and w.count(token) == int((ids == token).sum())
        assert w.find(token, w.count(token, i)) == i
    assert w.count(top - 1) == int((ids == top - 1).sum())
    with pytest.raises(IndexError):
        w.access(n)


LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_the_library():
    rng = random.Random(1)
    bits = ["the", "é", "𝄞", " ", "  ", "\n", "\t", " \n", "'s", "12", "a1!", "...", " ", "　", "<|endoftext|>", "a <|endoftext|> b", "don't", "\x1c", "\x85", "a.", "x,", "!.", "_.", "\x02", ".\x02", "​", "ция"]
    texts = ["", " ", "a ", " a", "a  b", "\n"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(600)] + [" ".join(rng.choice(bits) for _ in range(20)) for _ in range(200)]
    encoder = token_files.Encoder(PATH)
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, encoder.kind).tolist() == plain(text), repr(text)


def test_files_read_back(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 2000)
    rows = [(i * 37 % 101, f"Text number {i}, of words " * (i % 9), "x") for i in range(101)] + [(None, "no id", None), (200, "long text " * 20000, None), (201, "", ""), (7, None, None), (7, "same id", None), (7, "same id", "x"), (7, "another", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = token_files.token_files(df, PATH).orderBy("start").collect()
    want, at = {}, 0
    for i, t, _ in rows:
        ids = [*plain(t), 0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r.start == at
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    again = token_files.token_files(df.repartition(2), PATH).orderBy("start").collect()
    assert again == got  # rows that share an id included
    assert token_files.token_files(df.limit(0), PATH).count() == 0


class Counting:
    """The library's tokenizer, which writes down what it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.inner.encode_batch_fast(texts, **options)


def test_recurring_pieces_outlast_those_met_once(monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 1000)
    encoder = token_files.Encoder(PATH)
    encoder.tokenizer = Counting(encoder.tokenizer)
    often = "start " + " ".join(f"often{i}x" for i in range(300))
    for k in range(3):
        encoder.encode([often, "start " + " ".join(f"once{k}y{i}" for i in range(200))])
    for k in range(3, 9):  # many texts without them
        encoder.encode(["start " + " ".join(f"once{k}y{i}" for i in range(900))])
    encoder.tokenizer.given.clear()
    got = encoder.encode([often, often + " new"])
    assert not any("often" in text for text in encoder.tokenizer.given)
    assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == [plain(often), plain(often + " new")]


def test_pieces_are_looked_up_once_for_all_slices():
    encoder = token_files.Encoder(PATH)
    encoder.tokenizer = Counting(encoder.tokenizer)
    words = [f"word{i}z" for i in range(700)]
    columns = [pa.array([f"start {' '.join(words)}{sep}end"], pa.large_string()) for sep in ("\n", "  ", ". ", " <|endoftext|> ")]
    got = encoder.encode_columns([*columns, pa.array([], pa.large_string())])
    assert sum(text.count("word5z") for text in encoder.tokenizer.given) == 2  # once more in the text with an added token
    assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == [plain(c[0].as_py()) for c in columns]


def test_small_memory_changes_no_ids(monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 30)
    monkeypatch.setattr(token_files, "LONG", 6)
    rng = random.Random(3)
    bits = ["the", "é", "𝄞", "don't", "a1!", "ция", "<|endoftext|>", "Wort.", "x,", "1.", "!.", ".5", "longer-than-six", "'s"]
    encoder = token_files.Encoder(PATH)
    assert encoder.encode([]) == [] and encoder.encode(["", "a  b"])[0] == b""
    for _ in range(60):
        texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", " ", "\n", "  ", "\n\n"]) for _ in range(rng.randint(1, 15))) + rng.choice(bits) for _ in range(8)]
        got = encoder.encode_columns([pa.array(texts[:3], pa.large_string()), pa.array(texts[3:], pa.large_string())])
        assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == [plain(t) for t in texts]
        assert len(encoder.pieces) < 400
