"""Text similarities that Spark has no built-in for, as vectorised functions."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions import rules


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity (half the characters out of turn, rounded down, count as transposed), above 0.7 raised by a common prefix of up to four characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def jaro_winklers(x: list[str], y: list[str]) -> np.ndarray:
    """jaro_winkler() of each pair of texts; pairs of equal lengths are scored at once."""
    out, groups = np.zeros(len(x)), {}
    for k, pair in enumerate(zip(x, y, strict=True)):
        groups.setdefault(tuple(map(len, pair)), []).append(k)
    table = lambda texts, n: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
    for (n, m), own in groups.items():
        for k in range(0, len(own), SCORED):
            part = own[k : k + SCORED]
            if len(part) < 8 or not n or not m:
                out[part] = [jaro_winkler(x[i], y[i]) for i in part]
            else:
                out[part] = _scores(table([x[i] for i in part], n), table([y[i] for i in part], m))
    return out


def jaro_winkler_column(a: Column, b: Column, least: float = 0.0) -> Column:
    """jaro_winkler() of two columns; null with either null, and 0 for what does not reach the least similarity."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        known = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        found = jaro_winklers(x.iloc[known].tolist(), y.iloc[known].tolist())
        return pd.Series(np.where(found >= least - 1e-9, found, 0.0), index=known, dtype="float64").reindex(range(len(x))).set_axis(x.index)

    return score(a, b)


#: Counters of characters of a text; characters that share one only seem to be more in common.
COUNTERS = 64
#: Texts of the left that are compared with all of the right at once; pairs of equal lengths that are scored at once.
ROWS, SCORED = 16, 2048


def _codes(texts: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]


def _starts(texts: list[np.ndarray], place: dict[int, int], missing: int) -> np.ndarray:
    """The first four code points by their places in a list, 16 bits each; those that a text lacks are as given."""
    out = np.zeros(len(texts), np.uint64)
    for i in range(4):
        out = (out << np.uint64(16)) | np.array([place[t[i]] if len(t) > i else missing for t in texts], np.uint64)
    return out


def _bits(counts: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters up to their caps as as many bits each, 64 to a word (words by texts), and what is beyond the caps."""
    level = np.concatenate([np.arange(c) for c in caps])
    ones = np.repeat(counts, caps, axis=1) > level
    ones = np.pad(ones, ((0, 0), (0, -ones.shape[1] % 64)))
    words = np.packbits(ones, axis=1).view(np.uint64)
    return np.ascontiguousarray(words.T), np.maximum(counts - caps, 0).sum(axis=1).astype(np.int16)


def similar_pairs(left: list[str], right: list[str], least: float) -> list[tuple[int, int, float]]:
    """(i, j, similarity) of all pairs of different texts whose Jaro-Winkler similarity is at least that; up to 8,000 texts a side.

    For most pairs the characters that both have, in any order, and their common start tell that they
    cannot be. Characters are counted in bits, so that common ones are the ones of both.
    """
    if not left or not right:
        return []
    a, b = _codes(left), _codes(right)
    place = {c: i for i, c in enumerate(dict.fromkeys(c for t in (*a, *b) for c in t[:4].tolist()))}
    begin = _starts(b, place, len(place) + 1)
    order = np.argsort(begin, kind="stable")
    begin, b, right = begin[order], [b[k] for k in order], [right[k] for k in order]
    start = _starts(a, place, len(place))
    n, m = (np.array([len(t) for t in side]) for side in (a, b))
    counts = [np.array([np.bincount(t % COUNTERS, minlength=COUNTERS) for t in side]) for side in (a, b)]
    # Beyond the caps, common characters are bounded by the fewer of either text.
    caps = np.ceil(np.percentile(counts[1], 90, axis=0)).astype(int)
    (x, over), (y, beyond) = (_bits(c, caps) for c in counts)
    # The texts of the right that begin with the first 1, 2, 3 and 4 characters of one of the left stand together.
    ends = []
    for p in range(1, 5):
        shift = np.uint64(16 * (4 - p))
        ends.append((np.searchsorted(begin, start >> shift << shift), np.searchsorted(begin, ((start >> shift) + np.uint64(1)) << shift)))
    jaro = [(least - 1e-8 - 0.1 * p) / (1 - 0.1 * p) for p in range(5)]
    needs: dict[int, list[np.ndarray]] = {}
    pairs = []
    for i in range(0, len(a), ROWS):
        rows = range(i, min(i + ROWS, len(a)))
        common = np.minimum(over[i : i + ROWS, None], beyond)
        for w in range(len(x)):
            common += np.bitwise_count(x[w, i : i + ROWS, None] & y[w])
        need = np.empty(common.shape, np.int16)
        for k, r in enumerate(rows):
            if n[r] not in needs:
                inverse = 1 / max(1, n[r]) + 1 / np.maximum(m, 1)
                needs[n[r]] = [np.ceil((3 * v - 1) / inverse - 1e-6).clip(-1, 32000).astype(np.int16) for v in jaro]
            need[k] = needs[n[r]][0]
            for p, (low, high) in enumerate(ends, 1):
                need[k, low[r] : high[r]] = needs[n[r]][p][low[r] : high[r]]
        found = np.nonzero(common >= need)
        pairs.append((found[0] + i, found[1]))
    ii, jj = (np.concatenate(c) for c in zip(*pairs, strict=True))
    out = []
    (table, row), (other, place_of) = _by_length(a), _by_length(b)
    lengths = n[ii] * (int(m.max()) + 1) + m[jj]
    by_length = np.argsort(lengths, kind="stable")
    for part in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1):
        for k in range(0, len(part), SCORED):
            some = part[k : k + SCORED]
            i, j = ii[some], jj[some]
            if len(some) < 8:
                score = np.array([jaro_winkler(left[p], right[q]) for p, q in zip(i, j, strict=True)])
            else:
                score = _scores(table[n[i[0]]][row[i]], other[m[j[0]]][place_of[j]])
            for r in np.flatnonzero(score >= least - 1e-8).tolist():
                p, q, s = int(i[r]), int(j[r]), float(score[r])
                if left[p] != right[q] and round(s, 9) >= least:
                    out.append((p, int(order[q]), s))
    return out


def _by_length(texts: list[np.ndarray]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The texts of each length as rows of a table, and each text's row."""
    rows: dict[int, list[np.ndarray]] = {}
    place = np.zeros(len(texts), int)
    for i, t in enumerate(texts):
        place[i] = len(rows.setdefault(len(t), []))
        rows[len(t)].append(t)
    return {n: np.stack(own) for n, own in rows.items()}, place


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """jaro_winkler() of the texts in the rows of both, of one length each. Rows become columns, so that each step is on all of them."""
    (k, n), m = a.shape, b.shape[1]
    if not n or not m:
        return np.zeros(k) + (n == m)
    small = np.min_scalar_type(max(a.max(), b.max()))
    a, b = np.ascontiguousarray(a.T.astype(small)), np.ascontiguousarray(b.T.astype(small))
    reach, columns = max(0, max(n, m) // 2 - 1), np.arange(k)
    # The first of the free places weighs most; the weight of a taken one is 0.
    weights = np.repeat(np.arange(m, 0, -1, dtype=np.min_scalar_type(m))[:, None], k, axis=1)
    hit = np.zeros((n, k), bool)
    for i in range(n):
        low, high = max(0, i - reach), min(m, i + reach + 1)
        if low >= high:
            break
        best = ((b[low:high] == a[i]).view(np.uint8) * weights[low:high]).max(axis=0)
        hit[i] = best > 0
        some = columns[hit[i]]
        weights[m - best[some].astype(int), some] = 0
    a, b, hit, taken = a.T, b.T, hit.T, weights.T == 0
    count = hit.sum(axis=1)
    # Text by text the characters that were met, in the order of either one.
    unlike = np.concatenate([[0], np.cumsum(a[hit] != b[taken])])
    ends = np.cumsum(count)
    swapped = (unlike[ends] - unlike[ends - count]) // 2
    jaro = np.where(count > 0, (count / n + count / m + (count - swapped) / np.maximum(count, 1)) / 3, 0.0)
    short = min(4, n, m)
    prefix = np.cumprod(a[:, :short] == b[:, :short], axis=1).sum(axis=1)
    raised = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
    return np.where((a == b).all(axis=1), 1.0, raised) if n == m else raised


@lru_cache(maxsize=1 << 18)
def _fnv64(word: bytes) -> int:
    h = 14695981039346656037
    for byte in word:
        h = ((h ^ byte) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


#: Words of more bytes are hashed one by one, texts in groups of about so many characters.
LONG_WORD, GROUP = 64, 1 << 18


def _hashes(words: list[str]) -> np.ndarray:
    """FNV-1a of all words: one step for each place in a word, over all words that reach it."""
    data = [w.encode() for w in words]
    sizes = np.array([len(b) for b in data])
    order = np.argsort(-sizes, kind="stable")
    starts, joined = (np.cumsum(sizes) - sizes)[order], np.frombuffer(b"".join(data), np.uint8).astype("<u8")
    out = np.full(len(data), 14695981039346656037, "<u8")
    long = int((sizes > LONG_WORD).sum())
    reach = np.searchsorted(-sizes[order], -np.arange(LONG_WORD), "left")
    for i, n in enumerate(reach.tolist()):
        if n <= long:
            break
        out[long:n] = (out[long:n] ^ joined[starts[long:n] + i]) * np.uint64(1099511628211)
    out[:long] = [_fnv64(data[k]) for k in order[:long]]
    back = np.empty_like(out)
    back[order] = out
    return back


def simhashes(texts: list[str]) -> list[int]:
    """Of each text 64 bits by majority of the FNV-1a hashes of lower-cased words that are not stop words, as a signed integer."""
    counts = [Counter(w for w in t.lower().split() if w not in rules.SIMHASH_STOP_WORDS) for t in texts]
    place = {w: i for i, w in enumerate(dict.fromkeys(w for c in counts for w in c))}
    if not place:
        return [0] * len(texts)
    bits = np.unpackbits(_hashes(list(place)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    out = []
    for c in counts:
        ones = np.fromiter(c.values(), np.float64, len(c)) @ bits[[place[w] for w in c]] if c else np.zeros(64)
        out.append(int(np.packbits(2 * ones > c.total(), bitorder="little").view("<i8")[0]))
    return out


def simhash(text: str) -> int:
    return simhashes([text])[0]


def simhash_column(text: Column, clamp: bool = False) -> Column:
    """Simhash of a column, null as empty; with clamp, values with the top bit set become the greatest long."""

    @F.pandas_udf("long")
    def of(x: pd.Series) -> pd.Series:
        texts, out, start, size = x.fillna("").tolist(), [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size >= GROUP or end == len(texts):
                out += simhashes(texts[start:end])
                start, size = end, 0
        return pd.Series(out, dtype="int64")

    out = of(text)
    return F.when(out < 0, F.lit((1 << 63) - 1)).otherwise(out) if clamp else out


def hash_embedder(dimensions: int = 64):
    """An embedder for tests: texts to unit vectors from hashed words, the same in every run."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimensions)
            for w in t.lower().split():
                h = _fnv64(w.encode())
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            out.append((v / max(1e-10, float(np.sqrt(v @ v)))).tolist())
        return out

    return embed
