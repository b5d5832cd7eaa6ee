"""Token counts by prefix dynamic programming.

For byte-pair merges, the encoding of a prefix is the encoding of a shorter prefix and one last token, and two tokens
may adjoin exactly if merging their joint text gives the two back. So one pass over a word finds, for every place, the
last token and the exact number of tokens of the text cut there, without encoding any prefix anew. A word's counts are
kept for all its prefixes; a document's are running sums over its words. From them follow the total, the count of any
prefix, and the longest prefix within a budget of tokens.

The vocabulary is a ``tokenizers`` file of the kind: BPE with an end-of-word suffix, byte-level letters, NFC and lower
case, white space dropped.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words whose counts a worker remembers; past it, it starts anew. Bounds memory, not results.
REMEMBERED = 700_000


def byte_letters() -> list[str]:
    """The printable letter for each byte, by the rule of byte-level vocabularies: visible Latin-1 bytes stand for
    themselves, the others for the letters from 256 on, in order."""
    visible = {b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)}
    other = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(other)) for b in range(256)]


class _Totals(dict):
    """The tokens of whole words; a new word is counted at all its prefixes first."""

    def __init__(self, counter: PrefixCounts):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        return int(self.counter.counts(word)[-1])


class PrefixCounts:
    """Counts for every prefix of words under one vocabulary."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        inner = [t for t in self.vocab if not (t.endswith(self.end) and len(t) > len(self.end))]
        final = [t[: -len(self.end)] for t in self.vocab if t.endswith(self.end) and len(t) > len(self.end)]
        # what tokens can end in: longer candidates than these are not tried
        self.inner_tails = {t[k:] for t in inner for k in range(len(t))}
        self.final_tails = {t[k:] for t in final for k in range(len(t))}
        self.inner, self.final = set(inner), set(final)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.final_pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes | np.ndarray] = {}
        self.totals = _Totals(self)

    def merged(self, units: list[str]) -> list[str]:
        """Byte-pair merges by rank, leftmost first."""
        while len(units) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(units, units[1:], strict=False)))
            if rank == 1 << 60:
                break
            units[at : at + 2] = [units[at] + units[at + 1]]
        return units

    def units(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def adjoin(self, left: str, right: str, final: bool) -> bool:
        """May right follow left in an encoding? final: right ends the word. An empty left: may right stand alone?"""
        pairs = self.final_pairs if final else self.pairs
        if len(pairs) > 1_000_000:
            pairs.clear()
        token = right + self.end if final else right
        found = pairs[left, right] = self.merged([*left, *self.units(token)]) == ([left, token] if left else [token])
        return found

    def word(self, word: str) -> list[int]:
        """The exact number of tokens of each prefix of a word, by characters."""
        raw = word.encode()
        text = "".join(map(self.letters.__getitem__, raw))
        n, pairs, final_pairs, adjoin = len(text), self.pairs.get, self.final_pairs.get, self.adjoin
        inner, final, inner_tails, final_tails = self.inner, self.final, self.inner_tails, self.final_tails
        last, count, out = [""] * (n + 1), [0] * (n + 1), []
        for i in range(1, n + 1):
            if i == n or raw[i] & 0xC0 != 0x80:  # a character ends here: the count of the text cut here
                for j in range(i - 1, -1, -1):
                    t = text[j:i]
                    if t not in final_tails:
                        break
                    if t in final and (j == 0 or last[j]):
                        fits = final_pairs((last[j], t))
                        if adjoin(last[j], t, True) if fits is None else fits:
                            out.append(count[j] + 1)
                            break
            for j in range(i - 1, -1, -1):  # the last token if the word goes on
                t = text[j:i]
                if t not in inner_tails:
                    break
                if t in inner and (j == 0 or last[j]):
                    fits = pairs((last[j], t))
                    if adjoin(last[j], t, False) if fits is None else fits:
                        last[i], count[i] = t, count[j] + 1
                        break
        return out

    def normal(self, text: str) -> str:
        # per character, as the library does: no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def counts(self, word: str) -> bytes | np.ndarray:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
                self.totals.clear()
            values = self.word(word)
            found = bytes(values) if len(values) < 256 else np.array(values, np.int64)
            if len(values) < 256:
                self.known[word] = found
                self.totals[word] = values[-1]
        return found

    def total(self, text: str) -> int:
        """Tokens of a whole text: the counts at the last prefix of its words, and one for each special string."""
        n = 0
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                n += 1
            elif part:
                n += sum(map(self.totals.__getitem__, self.words.findall(self.normal(part))))
        return n

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """(ends, counts): at each character end inside a word or special string of the normalised text, the tokens so
        far. Between words the count stays. Ends are characters of the normalised text."""
        ends, counts, base, so_far = [], [], 0, 0
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                so_far += 1
                ends.append(base + len(part))
                counts.append(so_far)
                base += len(part)
                continue
            part = self.normal(part)
            for m in self.words.finditer(part):
                values = self.counts(m[0])
                ends += range(base + m.start() + 1, base + m.end() + 1)
                counts += [so_far + int(v) for v in values]
                so_far += int(values[-1])
            base += len(part)
        return ends, counts

    def within(self, text: str, budget: int) -> int:
        """The end of the longest prefix (in characters of the normalised text) of at most budget tokens.

        Counts of prefixes may fall inside a word, so the last place within the budget is looked up, not the first
        beyond it."""
        ends, counts = self.prefixes(text)
        fit = [e for e, c in zip(ends, counts, strict=True) if c <= budget]
        return fit[-1] if fit else 0


_made: dict[int, PrefixCounts] = {}


def _counter(spec: str) -> PrefixCounts:
    """One for each worker and vocabulary: its memory of words serves all tasks of the worker."""
    if hash(spec) not in _made:
        _made[hash(spec)] = PrefixCounts(spec)
    return _made[hash(spec)]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_column: str = "doc_id", text: str = "text", prefixes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit); with prefixes also
    fit_chars, the longest prefix (in characters of the normalised text) of at most limit tokens where the text is over
    it, else null, and the arrays prefix_ends and prefix_tokens.

    tokenizer is a path that the driver reads; its content goes to the workers. Special strings in texts count as one
    token, as is the library's default. Null texts count as empty. Repeated rows and null ids are rows like others;
    other columns are ignored."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary: bounded

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for part in batches:
            size, n, fit, ends, tokens = [], [], [], [], []
            for value in part.column(1):
                value = value.as_py() or ""
                size.append(len(value.encode()))
                n.append(counter.total(value))
                fit.append(counter.within(value, limit) if prefixes and n[-1] > limit else None)
                if prefixes:
                    e, t = counter.prefixes(value)
                    ends.append(e)
                    tokens.append(t)
            columns = [part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            if prefixes:
                columns += [pa.array(fit, pa.int64()), pa.array(ends, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))]
                names += ["fit_chars", "prefix_ends", "prefix_tokens"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return rows.mapInArrow(count, ddl + (", fit_chars long, prefix_ends array<int>, prefix_tokens array<int>" if prefixes else ""))
