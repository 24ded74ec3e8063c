"""Rule statistics and classifier features of whole texts, computed on Arrow slices."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.shared import _IS_BLANK, Words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80  # bytes that start a code point
_BEYOND = np.arange(256) >= 0xC0  # bytes that start a code point beyond ASCII


def _dense(codes: np.ndarray) -> np.ndarray:
    return pd.factorize(codes)[0]


def repeated_words(words: Words, ids: np.ndarray, kinds: int) -> np.ndarray:
    """For each text, how many of its words lie in a three-word window that occurs twice or more in it."""
    n = len(ids)
    owner = words.owner()
    if n < 3:
        return np.zeros(len(words.count), np.int64)
    inside = owner[2:] == owner[:-2]
    at = np.flatnonzero(inside)
    ids = ids.astype(np.int64)
    pairs = _dense(ids[:-1] * kinds + ids[1:]).astype(np.int64)
    windows = _dense(pairs[at] * kinds + ids[at + 2]).astype(np.int64)
    keyed = _dense(owner[at] * (int(windows.max(initial=0)) + 1) + windows)
    twice = np.bincount(keyed)[keyed] > 1 if len(keyed) else np.zeros(0, bool)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return np.bincount(owner[covered], minlength=len(words.count))


def repeated_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its lines with a word, and how many of them equal an earlier line."""
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    flat = lines.flatten().dictionary_encode()
    kinds = len(flat.dictionary)
    solid = Words(flat.dictionary).count > 0
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = solid[ids] if kinds else np.zeros(0, bool)
    keys, owner = owner[keep] * kinds + ids[keep], owner[keep]
    later = np.ones(len(keys), bool)
    later[pd.Series(np.arange(len(keys))).groupby(keys).first().to_numpy()] = False
    return np.bincount(owner, minlength=len(texts)), np.bincount(owner[later], minlength=len(texts))


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts that rules and classifier build on, each a long for each text."""
    words = Words(texts)
    coded = words.array().dictionary_encode()
    kinds = len(coded.dictionary)
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    data, owner = words.data, words.owner()
    lines, dup_lines = repeated_lines(texts)
    distinct = np.bincount(np.unique(owner * max(kinds, 1) + ids) // max(kinds, 1), minlength=len(texts)) if len(ids) else np.zeros(len(texts), np.int64)
    solid = ~_IS_BLANK[data]
    long_words = np.bincount(owner[(words.ends - words.starts) > 20], minlength=len(texts)) if len(ids) else np.zeros(len(texts), np.int64)
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": words.totals(solid & _STARTS[data]),
        "n_symbols": words.totals(_SYMBOL[data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated_words(words, ids, max(kinds, 1)),
        "n_lines": lines,
        "n_distinct": distinct,
        "n_marks": words.totals(_MARK[data]),
        "n_capitals": words.totals(_CAPITAL[data]),
        "n_digits": words.totals(_DIGIT[data]),
        "n_beyond": words.totals(_BEYOND[data]),
        "n_long": long_words,
        "n_stops": words.totals((data == 46) | (data == 63)),
        "n_bangs": words.totals(data == 33),
    }


NAMES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_marks n_capitals n_digits n_beyond n_long n_stops n_bangs"
).split()

#: What both models see: ratios that do not depend on a text's length, and the length itself.
FEATURES = "log_words mean_word symbols dup_lines repeats line_words variety marks capitals digits beyond long_words stops bangs".split()


def ratios(s: dict[str, np.ndarray]) -> np.ndarray:
    """A row of ``FEATURES`` for each text, from its statistics."""
    f = {k: v.astype(float) for k, v in s.items()}
    words, chars, lines = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1), np.maximum(f["n_lines"], 1)
    return np.column_stack(
        [
            np.log1p(f["n_words"]), f["word_chars"] / words, f["n_symbols"] / chars, f["n_dup_lines"] / lines, f["n_repeat_words"] / words,
            words / lines, f["n_distinct"] / words, f["n_marks"] / chars, f["n_capitals"] / chars, f["n_digits"] / chars, f["n_beyond"] / chars,
            f["n_long"] / words, f["n_stops"] / words, f["n_bangs"] / words,
        ]
    )
