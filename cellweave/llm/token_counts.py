"""Token counts with the whole-token shortcut.

Offline, every string of the vocabulary is encoded alone; those that come out as exactly one token form a
proven set. A text is cut by the tokenizer's pre-token pattern; a pre-token of the set counts as one token
without any merge, and only the rest is merged (and remembered, within a bound).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cellweave.llm.common import table, type_of

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which the pattern engines of Python and of the library agree; a text with others goes to the library whole.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏͰ-ͳ΄-ΊΎ-ΡΣ-ϿЀ-ԯ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*")
REMEMBERED = 300_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def prove_whole_tokens(spec: str) -> frozenset[str]:
    """Vocabulary strings that, as a text of their own, are one pre-token and one token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    back = {c: b for b, c in byte_letters().items()}
    special = {t["content"] for t in json.loads(spec)["added_tokens"]}
    texts = []
    for name in json.loads(spec)["model"]["vocab"]:
        if name in special:
            continue
        try:
            text = bytes(back[c] for c in name).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            continue  # part of a character: never a whole pre-token
        if PLAIN.fullmatch(text):
            texts.append(text)
    pattern = regex.compile(PATTERN)
    return frozenset(t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1 and pattern.fullmatch(t))


class TokenCounter:
    """Counts the tokens of a text exactly as the library does."""

    def __init__(self, spec: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.tok, self.whole, self.memo = Tokenizer.from_str(spec), whole, {}
        self.tok.no_truncation()
        self.tok.no_padding()
        self.find, self.letters = regex.compile(PATTERN).findall, {i: c for i, c in byte_letters().items()}
        special = [regex.escape(t["content"]) for t in json.loads(spec)["added_tokens"]]
        self.split = regex.compile("|".join(special)).split if special else lambda text: [text]

    def merged(self, word: str) -> int:
        n = self.memo.get(word)
        if n is None:
            if len(self.memo) >= REMEMBERED:
                self.memo.clear()
            n = len(self.tok.model.tokenize("".join(map(self.letters.__getitem__, word.encode("utf-8")))))
            if len(word) <= 64:
                self.memo[word] = n
        return n

    def count(self, text: str) -> int:
        if not PLAIN.fullmatch(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        parts = self.split(text) if "<|" in text else [text]
        n, whole, merged = len(parts) - 1, self.whole, self.merged
        for part in parts:
            for word in self.find(part):
                n += 1 if word in whole else merged(word)
        return n


_counters: dict[str, TokenCounter] = {}


def counter_of(spec: str, whole: frozenset[str]) -> TokenCounter:
    """One counter for a worker, so that what it remembers outlives a task."""
    if spec not in _counters:
        _counters.clear()
        _counters[spec] = TokenCounter(spec, whole)
    return _counters[spec]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs, one map over the texts, no shuffle.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids pass through, repeated rows give repeated rows,
    other columns are not read. Special strings in a text are one token each, as by the library's default.
    The proven set is broadcast; it is at most the vocabulary. ``path`` need only exist on the driver.
    """
    with open(path or default_path(), encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, prove_whole_tokens(spec)))
    kind = type_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
