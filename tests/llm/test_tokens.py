import hashlib
from types import SimpleNamespace

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeloom.llm.bpe import encode_documents, word_bpe
from noticeloom.llm.tokenlengths import count_batch, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "  two  blanks ", "▁ ▁a ▁", "<s> x </s>", "it's I'LL don't 'd", "<|endoftext|>a<|startoftext|> B<|endoftext|", "aaaaaaaaaaaa ааа", "ΣΑΣ İ ǅ ß", "é é̀", "1²½ ٣ 四 x​y", "a\x1cb\x85c d　e", "\u0000\x00 ﻿", "tab\tline\nend\r\n", "🙂🙂 👩‍👩‍👧", "x" * 3000, "word " * 2000]


@pytest.fixture(scope="module")
def reference():
    import sentencepiece
    from tokenizers import Tokenizer

    return sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)


def check(texts, reference):
    pieces, words = reference
    assert count_batch(texts, PIECES) == [len(pieces.encode(t)) for t in texts]
    for t, (n, ids, decoded) in zip(texts, word_bpe(WORDS).encode_batch(texts), strict=True):
        own = words.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, own)) and n == len(own), t
        assert decoded == words.decode(own, skip_special_tokens=False)


def test_odd_texts(reference):
    check(ODD, reference)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8", categories=("L", "M", "N", "P", "S", "Z")), st.sampled_from(" \n'sSteaé▁"))), max_size=4))
def test_like_the_libraries(reference, texts):
    check(texts, reference)


def test_frames(spark, reference):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "null id"), (0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as n_bytes")
    got = sorted(map(tuple, token_counts(docs, PIECES, limit=1500).collect()), key=str)
    pieces, words = reference
    assert got == sorted(((i, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 1500) for i, t in rows), key=str)
    coded = sorted(map(tuple, encode_documents(docs, WORDS).collect()), key=str)
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = [(i, words.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert coded == sorted(((i, len(x), hexed(" ".join(map(str, x))), hexed(words.decode(x, skip_special_tokens=False))) for i, x in own), key=str)
    assert encode_documents(docs.limit(0), WORDS).count() == token_counts(docs.limit(0), PIECES).count() == 0


def test_long_words(reference):
    """Words merged one by one get the library's ids, and a megabyte of letters takes seconds."""
    import random
    import time

    rnd = random.Random(2)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyzé語") for n in (511, 512, 700, 5000)]
    check([*texts, "a" * 4001, f"short {texts[3]} end"], reference)
    began = time.perf_counter()
    (n, ids, _), *_ = word_bpe(WORDS).encode_batch(["".join(rnd.choice("etaoinshrdlu") for _ in range(1_000_000))])
    assert n == len(ids.split()) > 100_000 and time.perf_counter() - began < 30


def test_batches_by_bytes():
    from noticeloom.llm.tokenlengths import balanced

    assert [(s.start, s.stop) for s in balanced([3, 3, 3, 9, 1, 0], 6)] == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(balanced([], 6)) == []


def test_repeated_pieces_cost_nothing_anew(monkeypatch):
    """The pattern of words sees each piece between blanks once, and a merge looks up its neighbours' pairs alone."""
    from types import SimpleNamespace

    import numpy as np

    from noticeloom.llm import bpe

    own, seen = bpe.WordBpe(WORDS), []
    pattern, search = own.words, np.searchsorted
    monkeypatch.setattr(own, "words", SimpleNamespace(findall=lambda s: seen.append(len(s)) or pattern.findall(s)))
    texts = ["Recall: model 12-B, it's unsafe. " * 500] * 4
    (n, *_), *_ = own.encode_batch(texts)
    assert n == 12 * 500 and sum(seen) < 100

    asked = []
    monkeypatch.setattr(bpe.np, "searchsorted", lambda a, v, *r, **k: asked.append(np.size(v) if a is own.keys else 0) or search(a, v, *r, **k))
    own.encode_words(["internationalizations"] * 100)
    assert 0 < sum(asked) < 100 * 3 * 21


def test_pieces_and_memory(reference, monkeypatch):
    """Small memories, long pieces that hold each other, special strings beside look-alikes: the ids are the library's."""
    from noticeloom.llm import bpe

    monkeypatch.setattr(bpe, "MEMO", 5)
    monkeypatch.setattr(bpe, "_loaded", {})
    han, word = "\u8bed\u8a00" * 40, "b" * 70
    odd = ["<|ENDOFTEXT|> <|endoftext|><|EndOfText|>", f"{han} {han},{word} {word} x.{word}.{han}", "a\x1fb \x1c \x1d\x85c\u3000d", "\u3000 \u2028", "it's don't' ''s \"'tis 's's", "\u03a3\u03a3. o\u03a3 \u03c3", "e\u0301 \u0301 \u2000x"]
    for _ in range(3):
        check([*odd, *ODD], reference)
        for t in reversed(odd):
            check([t], reference)
    kept = bpe.word_bpe(WORDS)
    assert all(len(p) <= bpe.MEMO_CHARS for p in (*kept.ids, *kept.old_ids)) and len(kept.ids) <= 5 and len(kept.old_ids) <= 10


def test_no_pieces_outlast_a_task(spark):
    """Workers are kept for other stages: after a task they hold the vocabulary and no pieces."""
    import pyarrow as pa

    def held(batches):
        from noticeloom.llm import bpe

        for batch in batches:
            own = bpe._loaded.get(WORDS)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(own.ids) + len(own.old_ids) if own else None] * batch.num_rows, pa.int64())})

    docs = spark.range(0, 4000, 1, 8).selectExpr("id AS doc_id", "concat('recall of model ', id, ' and unit x', id * 7) AS text")
    encode_documents(docs, WORDS).write.format("noop").mode("overwrite").save()
    left = [r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect() if r.n is not None]
    assert left and not any(left)


def test_no_pieces_outlast_a_task_stopped_early(spark, monkeypatch):
    from noticeloom.llm import bpe

    monkeypatch.setattr(bpe, "_loaded", {})
    docs = spark.createDataFrame([(1, "a recall")], "doc_id long, text string")
    frame = SimpleNamespace(select=lambda *c: SimpleNamespace(schema=docs.schema, mapInArrow=lambda run, schema: run))
    part = iter(encode_documents(frame, WORDS)(iter(docs.toArrow().to_batches())))
    next(part)
    assert bpe._loaded[WORDS].ids
    part.close()
    assert not bpe._loaded[WORDS].ids and not bpe._loaded[WORDS].old_ids
