"""N-gram repetition signals: how much of a text its repeated token runs make up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._parts import in_parts
from .tokens import WORD, tokens


def field_names(num_top: int, num_dup: int) -> list[str]:
    return [f"{'top' if n <= num_top else 'dup'}_{n}_gram_char_ratio" for n in range(1, num_dup + 1)]


def _check(num_top: int, num_dup: int) -> None:
    if num_top < 0 or num_dup < 0:
        raise ValueError("num_top and num_dup must be at least 0")
    if num_top > num_dup:
        raise ValueError("num_top can't exceed num_dup")


def token_signals(words: list[str], num_top: int, num_dup: int) -> list[float]:
    """The signals of one text.

    The n-gram that starts at each token gets a number: runs of equal number are equal n-grams, and the
    numbers of one length give those of the next. Sizes are in characters, without what lies between.
    """
    out = [0.0] * num_dup
    if not words:
        return out
    size = np.fromiter(map(len, words), np.int64, len(words))
    upto = np.r_[0, np.cumsum(size)]
    total = max(1, int(upto[-1]))
    first: dict[str, int] = {}
    token = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    kinds = len(first)
    name = token
    for n in range(1, min(num_dup, len(words)) + 1):
        if n > 1:
            name = np.unique(name[:-1] * kinds + token[n - 1 :], return_inverse=True)[1]
        if n <= num_top:
            chars = upto[n:] - upto[:-n]
            out[n - 1] = float(np.bincount(name, chars).max()) / total
        else:
            order = np.argsort(name, kind="stable")
            again = np.zeros(len(name), bool)
            again[order[1:]] = name[order[1:]] == name[order[:-1]]
            at = np.flatnonzero(again)
            if not len(at):
                # Longer n-grams can't repeat either.
                if n > num_top:
                    break
            cover = np.zeros(len(words) + 1, np.int64)
            cover[at] += 1
            cover[at + n] -= 1
            out[n - 1] = float(size[np.cumsum(cover)[:-1] > 0].sum()) / total
    return out


def batch_signals(words: pa.ListArray, num_top: int, num_dup: int) -> np.ndarray:
    """The signals of many texts at once, one row each (zeros for null).

    N-grams are numbered per text. Only those that stand twice in their text can grow into longer ones that do, so
    each length looks only at the places that the one before left; of n-grams that stand once, the longest counts.
    """
    rows = len(words)
    n_words = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((rows, num_dup))
    coded = words.flatten().dictionary_encode()
    token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(token):
        return out
    size = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[token]
    kinds = len(coded.dictionary)
    end = np.cumsum(n_words)
    text = np.repeat(np.arange(rows), n_words)
    upto = np.r_[0, np.cumsum(size)]
    total = np.maximum(1, upto[end] - upto[end - n_words])
    stop = end[text]
    at, name = np.arange(len(token)), text
    for n in range(1, num_dup + 1):
        fits = at + n <= stop[at]
        at, name = at[fits], name[fits]
        key = name * kinds + token[at + n - 1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        first = np.flatnonzero(new)
        many = np.diff(np.r_[first, len(key)])
        name = np.empty(len(key), np.int64)
        name[order] = np.cumsum(new) - 1
        if n <= num_top:
            begin = np.arange(len(token) - n + 1)
            begin = begin[begin + n <= stop[begin]]
            best = np.zeros(rows, np.int64)
            np.maximum.at(best, text[begin], upto[begin + n] - upto[begin])
            sums = np.bincount(name, upto[at + n] - upto[at], len(first)).astype(np.int64)
            np.maximum.at(best, text[at[order[first]]], sums)
            out[:, n - 1] = best / total
        else:
            again = at[order[~new]]
            cover = np.zeros(len(token) + 1, np.int64)
            cover[again] += 1
            cover[again + n] -= 1
            out[:, n - 1] = np.bincount(text, size * (np.cumsum(cover)[:-1] > 0), rows) / total
        stays = many[name] > 1
        at, name = at[stays], name[stays]
        if not len(at) and n >= num_top:
            break
    return out


def repetition_signals(expr: Column | str, *, tokenizer_pattern: str = WORD, num_top: int = 4, num_dup: int = 10) -> Column:
    """A struct of ``num_dup`` floats: top_1 .. top_{num_top}, then dup_{num_top + 1} .. dup_{num_dup}.

    ``top_n``: the largest share of token characters that the occurrences of one n-gram make up.
    ``dup_n``: the share of token characters in n-grams seen before. Null text gives null fields, text
    without tokens zeros. With ``num_dup=0`` the struct has no fields.
    """
    _check(num_top, num_dup)
    if not num_dup:
        return F.struct()
    names = field_names(num_top, num_dup)

    def signals(words: pa.Array) -> pa.Array:
        gone = words.is_null().to_numpy(zero_copy_only=False)
        grid = batch_signals(words, num_top, num_dup).astype(np.float32)
        return pa.StructArray.from_arrays([pa.array(grid[:, k], mask=gone) for k in range(num_dup)], names)

    schema = ", ".join(f"`{n}` float" for n in names)
    return F.arrow_udf(in_parts(signals), f"struct<{schema.replace('` ', '`:')}>")(tokens(expr, pattern=tokenizer_pattern))
