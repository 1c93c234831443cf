from __future__ import annotations

import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import documents, empty, rows
from tokenizers import Tokenizer

from cellweave.llm import token_counts as op

ODD = [
    "I'm you'll THEY'D it's 's 'S", "  two  spaces   three\n\n\nlines \t tab ", "<|endoftext|>", "a<|endoftext|>b<|endoftext|>", "<|endoftext", "x" * 5000, "é" * 500, "日本語のテキスト 漢字", "½ ① Ⅷ ﬁ", "a\x00b\x85c d", "İıſK",
    "עברית العربية हिन्दी ไทย", "👩‍👩‍👧‍👦 🏳️‍🌈", " 　 nbsp", "12345 67.89 3,14", "é combining", "﻿bom", " " * 300, "\n" * 300, "---===***", "ЖЯ ΑΒΓ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(op.default_path())


@pytest.fixture(scope="module")
def counter():
    with open(op.default_path(), encoding="utf-8") as f:
        spec = f.read()
    return op.TokenCounter(spec, op.prove_whole_tokens(spec))


def test_counts_are_the_library_s(counter, library):
    for text in ODD + [t or "" for _, t, *_ in rows()]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text[:60])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_counts_of_any_text(counter, library, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeT's 'll\n\t 1é日-<|>endoftext", max_size=80))
def test_counts_of_likely_text(counter, library, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_proven_strings_are_one_token_each(counter, library):
    whole = sorted(counter.whole)
    assert len(whole) > 20_000 and all(len(e.ids) == 1 for e in library.encode_batch(whole[::7], add_special_tokens=False))
    with open(op.default_path(), encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    assert "<|endoftext|>" in special and not any(s in counter.whole for s in special)


def test_query_rows(spark, library):
    got = op.token_counts(documents(spark)).collect()
    want = Counter()
    for i, t, *_ in rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert Counter(tuple(r) for r in got) == want
    assert op.token_counts(empty(spark)).collect() == []
