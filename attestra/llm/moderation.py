"""Tagging abusive, hateful and sexually explicit spans with a linear-chain conditional random field.

Words are compared in a canonical form that undoes spelling tricks (look-alike letters, digits for letters, stars, signs
or blanks between letters, stretched letters, invisible characters). Features of a token are its word, its neighbours, the classes of
``toxic_words`` it belongs to, those within a window around it and those of the nearest classified words. All weights are
trained, on sentences whose spans are marked (``reviewed``) and on a reviewed sample. That sample labels texts, so its
token labels are found by alternation: in a toxic text the segment that looks most toxic is labelled toxic, the field is
trained, and the labels are taken anew from its marginals. Near-equal segments of the sample share the weight of
the square root of their number, so a form that recurs does not outvote the rest.

Every segment is scored, also those in which no word belongs to a class (a trigger: a class of ``OFFENDING``): what the field has learned of
words alone decides there. Forward-backward marginals of a text give its offending spans, and one
less the probability that no token of a segment is toxic gives the segment's score; a text has the score of its worst segment.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reviewed
from .toxic_words import CLASSES, LEET, LOOKALIKES

#: Parameters: most rows of the reviewed sample that are used, tokens to either side that form the window, penalty of the
#: weights of words, that of classes as a share of it, score from which a text counts as toxic, weight of a marked sentence
#: against a form of the sample, share of word pairs from which segments count as near-equal.
SAMPLE_ROWS, REACH, PENALTY, CLASS_SHARE, THRESHOLD, MARKED, ALIKE = 20000, 8, 2.0, 0.1, 0.3, 2.0, 0.4

#: Bits of the classes in a mask; MSK marks words with stars or digits for letters.
BITS = {name: bit for bit, name in enumerate([*CLASSES, "MSK"])}
#: Classes whose words may offend.
OFFENDING = ("INS", "PRO", "THR", "DEG", "SEX", "CON", "MSK")

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_INNER = r"*@$!|+.\-_'’~·€¡#"
_LETTER = r"(?:[^\W_]|[\u0300-\u036f])"
_SPACED = r"(?<![^\W_])(?:[^\W_][  ._\-*·|/]{1,2}){2,}[^\W_](?![^\W_])"
_PLAIN = rf"(?:[@$](?=[^\W_]))?{_LETTER}+(?:[{_INNER}]{{1,12}}{_LETTER}+)*(?:\*{{2,}})?"
_TOKEN = re.compile(rf"{_SPACED}|{_PLAIN}")
_BREAK = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+(?![a-zß-ÿ])|[。！？\n\r  ]|\[\d+\]")
_REPEAT = re.compile(r"(.)\1+")
_STRETCHED = re.compile(r"(.)\1\1")
_PARTS = re.compile(r"[^\W_]+")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")  # scripts without blanks between words


def _squeezed(word: str) -> str:
    return _REPEAT.sub(r"\1", word)


def _plain(text: str) -> str:
    """Case, compatibility forms and accents undone."""
    text = unicodedata.normalize("NFKC", text).casefold()
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn") if not text.isascii() else text


class Lexicon:
    """Classes of words and the canonical form of tokens; ``words`` are further words that tricks may hide."""

    def __init__(self, words: set[str] = frozenset()):
        self.whole: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        for bit, tables in enumerate(CLASSES.values()):
            for table in tables.values():
                for entry in table.split():
                    entry = _plain(entry)
                    where = self.stems if entry.endswith("-") else self.whole
                    entry = entry.rstrip("-")
                    where[entry] = where.get(entry, 0) | 1 << bit
        self.masked = 1 << BITS["MSK"]
        self.longest = max(map(len, self.stems))
        self.triggers = sum(1 << BITS[name] for name in OFFENDING)
        unspaced = sorted((w for w in self.stems if _UNSPACED.match(w)), key=len, reverse=True)
        self.unspaced = re.compile("(" + "|".join(map(re.escape, unspaced)) + ")")
        self.strong = sum(1 << BITS[name] for name in ("INS", "PRO", "SEX", "DEG"))
        known = {w for t in (self.whole, self.stems) for w, m in t.items() if m & self.strong and len(w) > 2 and w.isascii()}
        self.hidden = known | {w for w in words if len(w) > 2}
        self.by_squeeze: dict[str, str] = {}
        for w in sorted(self.hidden):
            self.by_squeeze.setdefault(_squeezed(w), w)
        self.by_shape: dict[tuple[str, int], list[str]] = {}
        for w in sorted(self.hidden):
            for form in (w, w + "s", w + "ing", w + "e"):
                self.by_shape.setdefault((form[0], len(form)), []).append(form)
        self.cache: dict[str, list[tuple[str, int]]] = {}

    def classes(self, word: str) -> int:
        mask = self.whole.get(word, 0)
        for n in range(1, min(len(word), self.longest) + 1):
            mask |= self.stems.get(word[:n], 0)
        return mask

    def hides(self, word: str) -> str | None:
        """The known word that ``word`` is, begins with or is a stretched form of."""
        if word in self.hidden or self.classes(word) & self.strong:
            return word
        if _STRETCHED.search(word):
            short = _squeezed(word)
            for n in range(len(short), 2, -1):
                found = self.by_squeeze.get(short[:n])
                if found and (n == len(short) or found in self.stems or len(short) - n <= 2):
                    return found + short[n:]
        return None

    def _unstar(self, word: str) -> str | None:
        shape = re.compile(re.sub(r"\\\*", "[a-z]", re.escape(word)))
        return next((w for w in self.by_shape.get((word[0], len(word)), []) if shape.fullmatch(w)), None)

    def _cut(self, joined: str) -> list[str]:
        """Letters without blanks as known words, taking the longest at each place; what is no known word stays together."""
        out, rest, at = [], "", 0
        while at < len(joined):
            n = next((n for n in range(min(14, len(joined) - at), 1, -1) if (w := joined[at : at + n]) in self.hidden or w in self.whole and n > 2 or w in self.stems and n > 3), 0)
            if n:
                if rest:
                    out.append(rest)
                    rest = ""
                out.append(joined[at : at + n])
                at += n
            else:
                rest += joined[at]
                at += 1
        return [*out, rest] if rest else out

    def canonical(self, token: str) -> list[tuple[str, int]]:
        """(word, classes) of what a token says; mostly one word, several behind signs or where blanks were removed."""
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            found = self.cache[token] = self._canonical(token)
        return found

    def _canonical(self, token: str) -> list[tuple[str, int]]:
        word = _plain(_INVISIBLE.sub("", token))
        if _UNSPACED.search(word):  # a run without blanks: known stems wherever they stand
            return [(p, self.classes(p)) for p in self.unspaced.split(word) if p]
        if not word.isascii() and any("a" <= c <= "z" for c in word) or sum(c in LOOKALIKES for c in word) == len(word) > 3:
            mixed = "".join(LOOKALIKES.get(c, c) for c in word)
            if mixed.isascii():
                word = mixed
        if re.fullmatch(r"(?:[^\W_][  ._\-*·|/]{1,2}){2,}[^\W_]", word) and sum(c.isalpha() for c in word) > 2:
            letters = "".join(LEET.get(c, c) for c in word if c.isalnum())
            return [(w, self.classes(w)) for w in self._cut(letters)]
        if word.isalpha():
            hit = self.hides(word) or word
            return [(hit, self.classes(hit))]
        if not any(c.isalpha() for c in word):
            return [("#", 0)]
        if "*" in word:
            bare = re.sub(r"[^\w*]", "", word)
            found = self._unstar(bare) if "*" in bare and bare[0] != "*" else None
            if found is None and (found := self.hides(bare.replace("*", ""))) is None:
                return [("*", self.masked)]
            return [(found, self.classes(found) | self.masked)]
        for one in ("i", "l"):
            guess = "".join(LEET.get(c, c) if c != "1" else one for c in word)
            guess = re.sub(r"[^\w]|_", "", guess)
            if guess.isalpha() and (hit := self.hides(guess)):
                return [(hit, self.classes(hit) | (self.masked if any(c.isdigit() for c in word) else 0))]
        bare = re.sub(r"[\W_]", "", word)
        if bare.isalpha() and (hit := self.hides(bare)) and len(bare) > 3:
            return [(hit, self.classes(hit))]
        parts = [re.sub(r"\d+", "#", p) for p in _PARTS.findall(word)]
        return [(p, self.classes(p)) for p in parts]


def segments(text: str, lexicon: Lexicon, every: bool = False) -> list[list[tuple[str, int, int, int]]]:
    """Those segments of the text that hold a trigger, or all of them, as (word, classes, start, end); cut at sentence ends and line breaks."""
    origin = None
    if _INVISIBLE.search(text):
        keep = [i for i, c in enumerate(text) if not _INVISIBLE.match(c)]
        origin, text = [*keep, len(text)], "".join(text[i] for i in keep)
    out: list[list[tuple[str, int, int, int]]] = []
    current: list[tuple[list[tuple[str, int]], int, int]] = []
    last = mask = 0
    triggers, canonical, kept = lexicon.triggers, lexicon.canonical, lexicon.cache.get

    def close() -> None:
        if current and (every or mask & triggers):
            places = [(w, *((origin[a], origin[b - 1] + 1) if origin else (a, b))) for w, a, b in current]
            out.append([(w, c, a, b) for words, a, b in places for w, c in words])

    for m in _TOKEN.finditer(text):
        start, end = m.span()
        if current and (start > last + 1 or start > last and text[last] != " ") and _BREAK.search(text, last, start + 1):
            close()
            current, mask = [], 0
        token = m.group()
        words = kept(token) or canonical(token)
        for _, c in words:
            mask |= c
        current.append((words, start, end))
        last = end
    close()
    return out


def _bits(mask: int) -> list[int]:
    return [b for b in range(mask.bit_length()) if mask >> b & 1]


@functools.lru_cache(maxsize=100_000)
def _window_features(mask: int) -> tuple[str, ...]:
    bits = _bits(mask)
    return (*[f"s{b}" for b in bits], *[f"s{a}&{b}" for a in bits for b in bits if a < b])


@functools.lru_cache(maxsize=100_000)
def _own_features(own: int, mask: int) -> tuple[str, ...]:
    return tuple(x for c in _bits(own) for x in (f"c{c}", *[f"c{c}&{b}" for b in _bits(mask)]))


def _windows(masks: list[int]) -> list[int]:
    out = []
    for i in range(len(masks)):
        m = 0
        for c in masks[max(0, i - REACH) : i + REACH + 1]:
            m |= c
        out.append(m)
    return out


def _word_features(words: list[str], i: int) -> tuple[str, ...]:
    w = words[i]
    before, after = words[i - 1] if i else "^", words[i + 1] if i + 1 < len(words) else "$"
    return "w" + w, "p" + w[:5], f"b{before} {w}", f"a{w} {after}"


def _near(masks: list[int]) -> list[tuple[int, int]]:
    """For each token the classes of the nearest classified token before and behind it within the window."""
    out = []
    for i in range(len(masks)):
        before = next((m for m in reversed(masks[max(0, i - REACH) : i]) if m), 0) if masks[i] else 0
        out.append((before, next((m for m in masks[i + 1 : i + REACH + 1] if m), 0) if masks[i] else 0))
    return out


@functools.lru_cache(maxsize=100_000)
def _near_features(own: int, before: int, after: int) -> tuple[str, ...]:
    return tuple(x for c in _bits(own) for x in (*[f"c{b}>{c}" for b in _bits(before) or ["^"]], *[f"c{c}<{b}" for b in _bits(after) or ["$"]]))


def token_features(segment: list[tuple[str, int, int, int]]) -> list[tuple[str, ...]]:
    words, masks = [t[0] for t in segment], [t[1] for t in segment]
    around, near = _windows(masks), _near(masks)
    return [("1", *_word_features(words, i), *_window_features(around[i]), *_own_features(masks[i], around[i]), *_near_features(masks[i], *near[i])) for i in range(len(segment))]


class Field:
    """A linear-chain conditional random field over the labels clean and toxic.

    ``weights``: what a feature adds to toxic; ``chain``: start toxic, clean to toxic, toxic to clean, toxic to toxic.
    """

    def __init__(self, weights: dict[str, float], chain: np.ndarray):
        self.weights, self.chain = weights, chain
        self.before: dict[str, dict[str, float]] = {}  # of a word, what the word before it adds
        self.after: dict[str, dict[str, float]] = {}
        for f, x in weights.items():
            if f[0] in "ba":
                first, second = f[1:].split(" ")
                if f[0] == "b":
                    self.before.setdefault(second, {})[first] = x
                else:
                    self.after.setdefault(first, {})[second] = x
        self.alone: dict[str, float] = {}
        self.sums: dict[int | tuple[int, ...], float] = {}

    def quick_emissions(self, segment: list[tuple[str, int, int, int]]) -> list[float]:
        """``emissions`` from sums that are kept for words and for combinations of classes."""
        words = [t[0] for t in segment]
        out, classed = self._word_emissions(words), [(i, t[1]) for i, t in enumerate(segment) if t[1]]
        if not classed:
            return out
        around, sums, get, n = [0] * len(words), self.sums, self.weights.get, len(words)
        if len(sums) > 200_000:
            sums.clear()
        for i, m in classed:
            for j in range(max(0, i - REACH), min(n, i + REACH + 1)):
                around[j] |= m
        for i, m in enumerate(around):
            if m:
                x = sums.get(m)
                if x is None:
                    x = sums[m] = sum(get(f, 0.0) for f in _window_features(m))
                out[i] += x
        for k, (i, m) in enumerate(classed):
            before = classed[k - 1][1] if k and classed[k - 1][0] >= i - REACH else 0
            after = classed[k + 1][1] if k + 1 < len(classed) and classed[k + 1][0] <= i + REACH else 0
            key = m, around[i], before, after
            x = sums.get(key)
            if x is None:
                x = sums[key] = sum(get(f, 0.0) for f in (*_own_features(m, around[i]), *_near_features(m, before, after)))
            out[i] += x
        return out

    def _word_emissions(self, words: list[str]) -> list[float]:
        if len(self.alone) > 200_000:
            self.alone.clear()
        alone, before, after = self.alone, self.before, self.after
        bias, get, last, out = self.weights.get("1", 0.0), self.weights.get, len(words) - 1, []
        for i, w in enumerate(words):
            x = alone.get(w)
            if x is None:
                x = alone[w] = bias + get("w" + w, 0.0) + get("p" + w[:5], 0.0)
            if w in before:
                x += before[w].get(words[i - 1] if i else "^", 0.0)
            if w in after:
                x += after[w].get(words[i + 1] if i < last else "$", 0.0)
            out.append(x)
        return out

    def probability(self, emissions: list[float]) -> float:
        """Probability that some token is toxic."""
        s, ct, tc, tt = (math.exp(x) for x in self.chain)
        exp, log, first = math.exp, math.log, True
        c, t, clean = 1.0, 0.0, 0.0
        for x in emissions:
            e = exp(x if x < 30.0 else 30.0)
            c, t = (c, s * e) if first else (c + t * tc, (c * ct + t * tt) * e)
            first = False
            if c + t > 1e100:
                clean -= log(c + t)
                c, t = c / (c + t), t / (c + t)
        return 1.0 - exp(min(0.0, clean - log(c + t)))

    def emissions(self, segment: list[tuple[str, int, int, int]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in token) for token in token_features(segment)]

    def marginals(self, segment: list[tuple[str, int, int, int]]) -> tuple[float, list[float]]:
        """(probability that some token is toxic, that of each token)."""
        e = [math.exp(min(30.0, x)) for x in self.emissions(segment)]
        s, ct, tc, tt = (math.exp(x) for x in self.chain)
        n = len(e)
        fc, ft = [0.0] * n, [0.0] * n
        c, t, clean = 1.0, s * e[0], 0.0  # clean: log probability of the path without a toxic token
        for i in range(n):
            if i:
                c, t = c + t * tc, (c * ct + t * tt) * e[i]
            z = c + t
            c, t = c / z, t / z
            clean -= math.log(z)
            fc[i], ft[i] = c, t
        bc = bt = 1.0
        out = [0.0] * n
        for i in range(n - 1, -1, -1):
            if i < n - 1:
                bc, bt = bc + bt * ct * e[i + 1], bc * tc + bt * tt * e[i + 1]
                z = bc + bt
                bc, bt = bc / z, bt / z
            out[i] = ft[i] * bt / (fc[i] * bc + ft[i] * bt)
        return 1.0 - math.exp(min(0.0, clean)), out


def _minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, used = g.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            used.append(a)
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(used)):
            q += s * (a - r * (y @ q))
        slope, step = -(g @ q), 1.0 if past else 1.0 / max(1.0, float(np.linalg.norm(g)))
        for _ in range(20):
            new_value, new_g = f(x - step * q)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_g - g
        if s @ y > 1e-10:
            past = [*past[1 - memory :], (s, y, 1.0 / (s @ y))] if len(past) >= memory else [*past, (s, y, 1.0 / (s @ y))]
        x, done = x + s, value - new_value < 1e-6 * abs(value)
        value, g = new_value, new_g
        if done:
            break
    return x


def train_field(features: list[list[tuple[str, ...]]], labels: list[list[int]], shares: list[float], penalty: float = PENALTY, steps: int = 120) -> Field:
    """The field that maximises the penalised likelihood of the labelled segments, each counted by its share."""
    counts = Counter(f for segment in features for token in segment for f in token)
    index = {f: i for i, f in enumerate(sorted({f for f, n in counts.items() if n > 1 or f == "1"}))}
    order = sorted(range(len(features)), key=lambda i: len(features[i]))
    groups = [order[i : i + 256] for i in range(0, len(order), 256)]
    packed = []
    for group in groups:
        n, width = len(group), max(len(features[i]) for i in group)
        cell, feature = [], []
        gold, real = np.zeros((n, width)), np.zeros((n, width), bool)
        for row, i in enumerate(group):
            gold[row, : len(labels[i])] = labels[i]
            real[row, : len(labels[i])] = True
            for col, token in enumerate(features[i]):
                ids = [index[f] for f in token if f in index]
                feature += ids
                cell += [row * width + col] * len(ids)
        packed.append((np.array(cell, dtype=np.int64), np.array(feature, dtype=np.int64), gold, real, np.array([shares[i] for i in group])[:, None]))
    size = len(index)
    # classes carry over to words the sample doesn't show, so they are held back less than words
    held = penalty * np.array([CLASS_SHARE if f[0] in "sc" else 1.0 for f in sorted(index)] + [CLASS_SHARE] * 4)

    def cost(x: np.ndarray) -> tuple[float, np.ndarray]:
        total, grad = 0.5 * float(held @ np.square(x)), held * x
        s, ct, tc, tt = x[size:]
        for cell, feature, gold, real, share in packed:
            n, width = gold.shape
            e = np.bincount(cell, x[feature], n * width).reshape(n, width)
            fc, ft = np.zeros((n, width)), np.zeros((n, width))
            ft[:, 0] = s + e[:, 0]
            for j in range(1, width):
                c = np.logaddexp(fc[:, j - 1], ft[:, j - 1] + tc)
                t = np.logaddexp(fc[:, j - 1] + ct, ft[:, j - 1] + tt) + e[:, j]
                fc[:, j], ft[:, j] = np.where(real[:, j], c, fc[:, j - 1]), np.where(real[:, j], t, ft[:, j - 1])
            z = np.logaddexp(fc[:, -1], ft[:, -1])
            bc, bt = np.zeros((n, width)), np.zeros((n, width))
            for j in range(width - 2, -1, -1):
                c = np.logaddexp(bc[:, j + 1], ct + e[:, j + 1] + bt[:, j + 1])
                t = np.logaddexp(tc + bc[:, j + 1], tt + e[:, j + 1] + bt[:, j + 1])
                bc[:, j], bt[:, j] = np.where(real[:, j + 1], c, 0), np.where(real[:, j + 1], t, 0)
            p = np.where(real, np.exp(ft + bt - z[:, None]), 0.0)
            both = real[:, 1:]
            pct = np.where(both, np.exp(fc[:, :-1] + ct + e[:, 1:] + bt[:, 1:] - z[:, None]), 0.0)
            ptc = np.where(both, np.exp(ft[:, :-1] + tc + bc[:, 1:] - z[:, None]), 0.0)
            ptt = np.where(both, np.exp(ft[:, :-1] + tt + e[:, 1:] + bt[:, 1:] - z[:, None]), 0.0)
            g0, g1 = gold[:, :-1], gold[:, 1:]
            nct, ntc, ntt = share * (1 - g0) * g1 * both, share * g0 * (1 - g1) * both, share * g0 * g1 * both
            total += float((share[:, 0] * z).sum() - (share * gold * e).sum() - s * (share[:, 0] * gold[:, 0]).sum())
            total -= float(ct * nct.sum() + tc * ntc.sum() + tt * ntt.sum())
            grad[:size] += np.bincount(feature, (share * (p - gold)).ravel()[cell], size)
            grad[size] += (share[:, 0] * (p[:, 0] - gold[:, 0])).sum()
            grad[size + 1] += (share * pct).sum() - nct.sum()
            grad[size + 2] += (share * ptc).sum() - ntc.sum()
            grad[size + 3] += (share * ptt).sum() - ntt.sum()
        return total, grad

    x = _minimise(cost, np.zeros(size + 4), steps)
    return Field({f: float(x[i]) for f, i in index.items() if abs(x[i]) > 1e-4}, x[size:])


class Tagger:
    """``field`` scores segments with a trigger, ``rest`` (trained on every segment) those without."""

    def __init__(self, lexicon: Lexicon, field: Field, rest: Field):
        self.lexicon, self.field, self.rest = lexicon, field, rest

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """(score, offending spans as code points): (0, []) for a null, empty or blank text."""
        best, spans = 0.0, []
        for segment in segments(text, self.lexicon, every=True) if text else []:
            field = self.field if any(c & self.lexicon.triggers for _, c, *_ in segment) else self.rest
            probability = field.probability(field.quick_emissions(segment))
            best = max(best, probability)
            if probability < 0.5:  # no token can reach that
                continue
            _, marginals = field.marginals(segment)
            for (_, _, a, b), p in zip(segment, marginals):
                if p >= 0.5:
                    if spans and spans[-1][2] is segment:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b, segment])
        return best, [(a, b) for a, b, _ in spans]


def near_equal_groups(segments: list[list[tuple[str, int, int, int]]], alike: float = ALIKE) -> list[int]:
    """For each segment the number of the first one with at least ``alike`` of the neighbouring word pairs in common."""
    heads: list[set[tuple[str, str]]] = []
    holders: dict[tuple[str, str], list[int]] = {}
    out = []
    for segment in segments:
        words = ["^", *[t[0] for t in segment], "$"]
        pairs = set(zip(words, words[1:]))
        common = Counter(h for p in pairs for h in holders.get(p, ()))
        head = next((h for h, n in common.most_common(3) if n >= alike * min(len(heads[h]), len(pairs))), None)
        if head is None:
            head = len(heads)
            heads.append(pairs)
            for p in pairs:
                holders.setdefault(p, []).append(head)
        out.append(head)
    return out


def marked_sentences() -> list[tuple[str, tuple[int, int] | None]]:
    """(text, offending span) of the fixed sentences; None for clean ones."""
    toxic = [(line.replace("[", "").replace("]", ""), (line.index("["), line.index("]") - 1)) for line in reviewed.TOXIC.strip().splitlines()]
    return [*toxic, *[(line, None) for line in reviewed.CLEAN.strip().splitlines()]]


def train_tagger(texts: list[str], toxic: list[bool], rounds: int = 3, penalty: float = PENALTY, steps: int = 120) -> Tagger:
    """A tagger from the marked sentences and from texts of which only the whole is known to be toxic or clean."""
    marked = marked_sentences()
    lexicon = Lexicon()
    parsed = [segments(text, lexicon) for text in texts]
    words_of = {True: Counter(), False: Counter()}
    for p, bad in zip(parsed, toxic):
        words_of[bad].update({w for s in p for w, *_ in s if w.isalpha() and w.isascii()})
    n_clean, n_toxic = max(1, toxic.count(False)), max(1, toxic.count(True))

    def odds(w: str) -> float:
        return math.log((words_of[True][w] + 0.5) / (n_toxic + 1)) - math.log((words_of[False][w] + 0.5) / (n_clean + 1))

    lexicon = Lexicon({w for w, n in words_of[True].items() if n >= 3 and len(w) >= 4 and odds(w) > 2})

    def first_guess(segment: list[tuple[str, int, int, int]]) -> float:
        values = sorted((odds(w) + (1.5 if c & lexicon.strong else 0.0) for w, c, *_ in segment), reverse=True)
        return sum(values[:4])

    fields = [_train(texts, toxic, marked, lexicon, every, first_guess, rounds, penalty, steps) for every in (False, True)]
    lexicon.cache.clear()
    return Tagger(lexicon, *fields)


def _train(texts, toxic, marked, lexicon, every, first_guess, rounds, penalty, steps) -> Field:
    """The field of the segments with a trigger, or of every segment."""
    parsed = [segments(text, lexicon, every) for text in texts]
    heads = near_equal_groups([s for p in parsed for s in p])
    sizes = Counter(heads)
    share = iter([sizes[h] ** -0.5 for h in heads])
    shares = [[next(share) for _ in p] for p in parsed]
    features = [[token_features(s) for s in p] for p in parsed]
    fixed = [(token_features(s), [int(span is not None and a < span[1] and b > span[0]) for *_, a, b in s]) for text, span in marked for s in segments(text, lexicon, every)]

    labels = []
    for p, bad in zip(parsed, toxic):
        worst = max(range(len(p)), key=lambda i: first_guess(p[i])) if bad and p else -1
        labels.append([[int(i == worst)] * len(s) for i, s in enumerate(p)])
    skip = [False] * len(texts)
    for turn in range(rounds):
        flat = [(f, y, w) for doc, ys, ws, out in zip(features, labels, shares, skip) if not out for f, y, w in zip(doc, ys, ws)]
        flat += [(f, y, MARKED) for f, y in fixed]
        # labels are still found while turns remain, so these fields need no precision
        field = train_field(*map(list, zip(*flat)), penalty, steps if turn == rounds - 1 else steps // 5)
        if turn == rounds - 1:
            break
        for k, (p, bad) in enumerate(zip(parsed, toxic)):
            scored = [field.marginals(s) for s in p]
            worst = max(range(len(p)), key=lambda i: scored[i][0]) if p else -1
            if bad:
                labels[k] = [[int(m >= 0.5 or (i == worst and max(ms) < 0.5)) for m in ms] for i, (_, ms) in enumerate(scored)]
            skip[k] = bool(p) and (scored[worst][0] > 0.97 if not bad else scored[worst][0] < 0.2)  # wrongly labelled, most likely
    return field


def fit(sample: DataFrame, text: str, category: str, clean: str = "none", sample_rows: int = SAMPLE_ROWS) -> Tagger:
    """A tagger from reviewed rows: at most ``sample_rows`` of them, chosen by a hash of the text. Rows with a null text or
    category are left out; any category but ``clean`` (folded) is toxic."""
    rows = sample.select(F.col(text).alias("text"), F.lower(F.trim(F.col(category))).alias("category")).dropna()
    rows = rows.orderBy(F.xxhash64("text"), "text", "category").limit(sample_rows).toArrow()
    return train_tagger(rows["text"].to_pylist(), [c != clean for c in rows["category"].to_pylist()])


def score_texts(df: DataFrame, key: str, text: str, tagger: Tagger, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, ``keep`` columns, score (0..1) and spans (array of start and end, in code points) of every row.

    Null, empty and blank texts have score 0 and no spans. Repeated rows and null keys are scored like any other.
    """
    model = df.sparkSession.sparkContext.broadcast(tagger)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [model.value.score(t) for t in batch["__text"].to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in results]
            columns = [batch[i] for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[0] for r in results], pa.float64()), pa.array(spans, span)], [*names, "score", "spans"])

    rows = df.select(key, *keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(score, f"{fields}, score double, spans array<struct<start:int,end:int>>")
