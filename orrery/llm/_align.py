"""Patterns found in normalised bytes: seeds from hashed grams, diagonal bands, and banded alignment in batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from orrery.llm._flat import LOWER, U64, buffers, mix, pieces

FAR = 1 << 20
SEEDS, PERIOD, BINS = 1 << 17, 64, 18


def _plain() -> np.ndarray:
    """A-Z in lower case; white space, controls and ASCII punctuation as a space; other bytes as they are."""
    table = LOWER.copy()
    for b in range(128):
        if not chr(b).isalnum():
            table[b] = 0x20
    return table


PLAIN = _plain()


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain bytes with single spaces, the place in ``raw`` of each, and the new offsets."""
    plain = PLAIN[raw]
    blank = plain == 0x20
    keep = ~blank
    begins = np.zeros(len(raw) + 1, bool)
    begins[offsets] = True
    keep[1:] |= ~blank[:-1] & ~begins[1:-1]
    kept = np.flatnonzero(keep)
    return plain[kept], kept, np.searchsorted(kept, offsets)


def grams(plain: np.ndarray, offsets: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the q bytes (8 at most) at each place, and whether they lie in one text."""
    n = len(plain) - q + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    padded = np.concatenate([plain, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), "<u8", padded, 0, (1,)).copy()
    if q < 8:
        words &= U64((1 << (8 * q)) - 1)
    inside = np.ones(n, bool)
    for end in offsets[1:-1]:
        inside[max(0, end - q + 1) : end] = False
    return words, inside


def edit_distances(patterns: np.ndarray, lengths: np.ndarray, texts: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern (row, padded) against some part of its text (row, padded by 255) within a band of
    ``band`` diagonals from the row's begin, and the text place where that part ends. All rows advance together."""
    n, width = patterns.shape
    steps = np.arange(band)
    cost = np.zeros((n, band), np.int32)
    best, ends = np.full(n, FAR, np.int32), np.zeros(n, np.int64)
    for i in range(width):
        same = patterns[:, i, None] == texts[:, i : i + band]
        new = cost + ~same
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        cost = new.astype(np.int32)
        done = lengths == i + 1
        if done.any():
            at = cost[done].argmin(1)
            best[done] = cost[done][np.arange(len(at)), at]
            ends[done] = i + at + 1
    return best, ends


def told_elsewhere(plain: np.ndarray, offsets: np.ndarray, span: int) -> np.ndarray:
    """Places that lie deep inside a periodic stretch of a text: whatever ``span`` bytes match there do so, alike, a number of
    periods before and after, up to both ends of the stretch, where places are kept. Periods up to PERIOD are looked for, which
    must not exceed span, as stretches of different periods overlap by less than both together."""
    told = np.zeros(len(plain), bool)
    words = np.ndarray((len(plain),), "<u8", np.concatenate([plain, np.zeros(8, np.uint8)]), 0, (1,))
    spots = np.arange(0, len(plain), span)  # a stretch that is long enough repeats itself for ``span`` bytes from one of these
    for p in range(1, min(PERIOD, span, len(plain) - 1) + 1):
        at = spots
        for k in range(0, span - 7, 8):
            at = at[at + k + p < len(plain)]
            at = at[words[at + k] == words[at + k + p]]
        own = np.unique(np.searchsorted(offsets, at, "right") - 1)  # texts to be looked at byte by byte
        for a, b in zip(offsets[own].tolist(), offsets[own + 1].tolist()):
            same = plain[a + p : b] == plain[a : max(a, b - p)]
            broken = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
            for k in np.flatnonzero(np.diff(broken) > 2 * span + 2 * p).tolist():
                told[a + broken[k] + 1 + span + p : a + broken[k + 1] - span] = True
    return told


def slices(at: np.ndarray, count: np.ndarray, span: int):
    """Runs of places with about SEEDS seeds, or of two spans if these have more; each begins a span before the last one ends."""
    total, a = np.cumsum(count), 0
    while a < len(at):
        b = int(np.searchsorted(total, total[a] - count[a] + SEEDS, "right"))
        b = max(b, int(np.searchsorted(at, at[a] + 2 * span, "right")))
        yield a, b
        a = len(at) if b >= len(at) else int(np.searchsorted(at, at[b] - span, "left"))


class Patterns:
    """Pieces of named texts: ``size`` bytes, ``step`` (or ``size // 2``) apart (a shorter text whole), with budgets of edits."""

    def __init__(self, texts: list[tuple[int, str]], q: int, size: int, rate: float, step: int | None = None):
        self.q, self.rate, step = q, rate, step or size // 2
        self.owner, self.start, rows = [], [], []
        self.total: dict[int, int] = {}
        for key, text in texts:
            raw, offsets = buffers(pa.array([text], pa.large_string()))
            plain = normalise(raw, offsets)[0].tobytes().strip()
            self.total[key] = len(plain)
            if len(plain) < q:
                continue
            for at in sorted({*range(0, max(1, len(plain) - size + 1), step), max(0, len(plain) - size)}):
                self.owner.append(key)
                self.start.append(at)
                rows.append(np.frombuffer(plain[at : at + size], np.uint8))
        self.owner, self.start = np.array(self.owner, np.int64), np.array(self.start, np.int64)
        self.length = np.array([len(r) for r in rows], np.int64)
        self.budget = np.floor(self.length * rate).astype(np.int64)
        self.need = self.length - q + 1 - q * self.budget
        self.rows = np.zeros((len(rows), size), np.uint8)
        for k, r in enumerate(rows):
            self.rows[k, : len(r)] = r
        self.bound()
        self._index([(k, r) for k, r in enumerate(rows)])

    def bound(self) -> None:
        """The lemma says nothing where the bound is below one."""
        if len(self.need) and self.need.min() < 1:
            raise ValueError(f"grams of {self.q} bytes are too long for these texts and edits")

    def chosen(self, hashes: np.ndarray) -> np.ndarray:
        """Places whose grams are indexed; all of them here."""
        return np.arange(len(hashes))

    def _index(self, rows) -> None:
        found = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, row in rows:
            words, _ = grams(row, np.array([0, len(row)]), self.q)
            at = self.chosen(mix(words))
            found.append((words[at], np.full(len(at), k), at))
        words, piece, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(words, kind="stable")
        self.words, self.piece, self.place = words[order], piece[order], place[order]
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(mix(self.words) >> U64(42)).astype(np.int64)] = True

    def seeds(self, plain: np.ndarray, offsets: np.ndarray, least: int = 1):
        """(text, piece, diagonal, place) of each gram that a piece shares, in slices of bounded size that hold every occurrence
        whole. least: leave out those that are not among so many within the span of an occurrence, as no piece can reach
        its bound there."""
        words, inside = grams(plain, offsets, self.q)
        at = np.flatnonzero(self.bloom[(mix(words) >> U64(42)).astype(np.int64)] & inside)
        if least > 1:
            span = int((self.length + self.budget).max())
            dense = np.flatnonzero(at[least - 1 :] - at[: max(0, len(at) - least + 1)] <= span)
            edge = np.zeros(len(at) + 1, np.int32)
            np.add.at(edge, dense, 1)
            np.add.at(edge, dense + least, -1)
            at = at[np.cumsum(edge[:-1]) > 0]
        low = np.searchsorted(self.words, words[at], "left")
        count = np.searchsorted(self.words, words[at], "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        span = int((self.length + self.budget).max())
        if count.sum() > SEEDS:
            told = told_elsewhere(plain, offsets, span)[at]
            at, low, count = at[~told], low[~told], count[~told]
        for a, b in slices(at, count, span):
            which = np.repeat(low[a:b], count[a:b]) + np.arange(count[a:b].sum()) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
            place = np.repeat(at[a:b], count[a:b])
            yield self.expand(np.searchsorted(offsets, place, "right") - 1, which, place)

    def expand(self, text, which, place):
        return text, self.piece[which], place - self.place[which], place

    def candidates(self, text, piece, diagonal, place, need):
        """Regions (text, piece, first diagonal) whose band holds ``need`` shared grams. Bands are two budgets wide
        (and one more), and overlap by half, so that the diagonals of an occurrence lie in one of them."""
        half = self.budget[piece] + 1
        band = np.concatenate([diagonal // half, diagonal // half - 1])
        text, piece, place = (np.concatenate([x, x]) for x in (text, piece, place))
        order = np.lexsort((place, band, piece, text))
        text, piece, band, place = text[order], piece[order], band[order], place[order]
        new = np.ones(len(text), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(piece) != 0) | (np.diff(band) != 0)
        fresh = new.copy()
        fresh[1:] |= np.diff(place) != 0  # a place counts once in a band
        head = np.flatnonzero(new)
        count = np.add.reduceat(fresh.astype(np.int64), head) if len(head) else head
        good = head[count >= need[piece[head]]]
        return text[good], piece[good], band[good] * (self.budget[piece[good]] + 1)

    def reaching(self, text, piece, share: float) -> np.ndarray:
        """Which candidates belong to a text and owner whose candidate pieces together hold ``share`` of the owner's
        bytes; the others cannot reach it, however they align."""
        order = np.lexsort((piece, text))  # the pieces of an owner follow each other, by their starts
        t, p = text[order], piece[order]
        own = self.owner[p]
        new = np.ones(len(p), bool)
        new[1:] = (np.diff(t) != 0) | (np.diff(own) != 0)
        start, stop = self.start[p], self.start[p] + self.length[p]
        added = self.length[p].copy()
        added[1:] = np.where(new[1:], added[1:], np.minimum(stop[1:] - start[1:], stop[1:] - stop[:-1]))
        group = np.cumsum(new) - 1
        total = np.array([self.total[k] for k in own[new].tolist()], np.int64)
        good = np.bincount(group, weights=added, minlength=len(total)) >= share * total - 1e-6
        out = np.zeros(len(p), bool)
        out[order] = good[group]
        return out

    def find(self, texts: pa.Array, need: np.ndarray | None = None, share: float = 0.0):
        """Arrays of verified regions: text, piece, edits, and the bytes [start, end) of the text they cover, the start taken as
        the end less the piece's length, so insertions and deletions move it by the budget at most; share: leave out
        owners that cannot be covered so far."""
        raw, offsets = buffers(texts)
        need = self.need if need is None else need
        out = [tuple(np.zeros(0, np.int64) for _ in range(5))]
        for a, b in pieces(offsets) if len(self.owner) else ():
            own = offsets[a : b + 1] - offsets[a]
            plain, back, at = normalise(raw[offsets[a] : offsets[b]], own)
            regions = [np.stack(self.candidates(*seeds, need)) for seeds in self.seeds(plain, at, int(need.min()))] or [np.zeros((3, 0), np.int64)]
            text, piece, first = np.unique(np.concatenate(regions, 1), axis=1) if len(regions) > 1 else regions[0]
            if share and len(text):
                good = self.reaching(text, piece, share)
                text, piece, first = text[good], piece[good], first[good]
            for k in range(0, len(text), 4096):
                t, p, d = text[k : k + 4096], piece[k : k + 4096], first[k : k + 4096]
                slack = int(self.budget[p].max())
                band = 2 * (slack + 1) + 2 * slack + 1
                begin = d - self.budget[p]
                spots = begin[:, None] + np.arange(self.rows.shape[1] + band)
                window = np.where((spots >= at[t][:, None]) & (spots < at[t + 1][:, None]), plain[np.clip(spots, 0, max(len(plain) - 1, 0))], 255).astype(np.uint8)
                edits, ends = edit_distances(self.rows[p], self.length[p], window, band)
                ok = edits <= self.budget[p]
                t, p, edits = t[ok], p[ok], edits[ok]
                stop = np.minimum(begin[ok] + ends[ok], at[t + 1])
                start = np.maximum(stop - self.length[p], at[t])
                out.append((t + a, p, edits.astype(np.int64), back[start] - own[t], back[stop - 1] + 1 - own[t]))
        return tuple(np.concatenate(x) for x in zip(*out))


class Windows(Patterns):
    """Patterns a short step apart. A gram is indexed once a text, and only grams that lie close to enough others on
    like diagonals are looked at in each piece that holds them, so the index does not grow with the overlap."""

    def _index(self, rows) -> None:
        new = np.ones(len(self.owner), bool)
        new[1:] = self.start[1:] == 0
        self.first = np.flatnonzero(new)  # of each text, its first piece and, one more, the next text's
        last = np.append(self.first[1:], len(self.owner))
        found = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b in zip(self.first.tolist(), last.tolist()):
            whole = np.zeros(int(self.start[b - 1] + self.length[b - 1]), np.uint8)
            for k in range(a, b):
                whole[self.start[k] : self.start[k] + self.length[k]] = self.rows[k, : self.length[k]]
            words, _ = grams(whole, np.array([0, len(whole)]), self.q)
            at = np.arange(len(words))
            low = a + np.searchsorted(self.start[a:b], at + self.q - self.length[a], "left")
            found.append((words, np.full(len(at), a), at, low, a + np.searchsorted(self.start[a:b], at, "right")))
        words, piece, place, low, high = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(words, kind="stable")
        self.words, self.piece, self.place = words[order], piece[order].astype(np.int32), place[order].astype(np.int32)
        self.low, self.high = low[order].astype(np.int32), high[order].astype(np.int32)
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(mix(self.words) >> U64(42)).astype(np.int64)] = True

    def expand(self, text, which, place):
        """Seeds in every piece that holds their gram. Grams of a piece within its budget are on diagonals of one band
        and in places no further apart than the piece and its budget: seeds without so many others there are left out."""
        piece, diagonal = self.piece[which].astype(np.int64), place - self.place[which]
        half = self.budget[piece] + 1
        band = np.concatenate([diagonal // half, diagonal // half - 1])
        # bands share bins of a rough count, and only seeds of full bins are sorted
        bins = (mix((np.tile(text, 2) << 40 ^ np.tile(piece, 2) << 20 ^ band).view(U64)) >> U64(64 - BINS)).astype(np.int64)
        full = np.bincount(bins, minlength=1 << BINS)[bins] >= np.tile(self.need[piece], 2)
        seed, band = np.flatnonzero(full) % len(place), band[full]
        t, p, x = text[seed], piece[seed], place[seed]
        order = np.lexsort((x, band, p, t))
        seed, t, p, x, band = seed[order], t[order], p[order], x[order], band[order]
        new = np.ones(len(t), bool)
        new[1:] = (np.diff(t) != 0) | (np.diff(p) != 0) | (np.diff(band) != 0)
        fresh = new.copy()
        fresh[1:] |= np.diff(x) != 0
        spot, group = np.cumsum(fresh) - 1, (np.cumsum(new) - 1)[fresh]
        p, x = p[fresh], x[fresh]
        ahead = np.arange(len(x)) + self.need[p] - 1
        k = np.flatnonzero(ahead < len(x))
        k = k[(group[ahead[k]] == group[k]) & (x[ahead[k]] - x[k] <= self.length[p[k]] - self.q + self.budget[p[k]])]
        edge = np.zeros(len(x) + 1, np.int32)
        np.add.at(edge, k, 1)
        np.add.at(edge, ahead[k] + 1, -1)
        keep = np.zeros(len(place), bool)
        keep[seed[(np.cumsum(edge[:-1]) > 0)[spot]]] = True
        text, place, diagonal, low, high = text[keep], place[keep], diagonal[keep], self.low[which[keep]], self.high[which[keep]]
        count = (high - low).astype(np.int64)
        one = np.repeat(np.arange(len(count)), count)
        piece = low[one] + np.arange(len(one)) - (np.cumsum(count) - count)[one]
        return text[one], piece, diagonal[one] + self.start[piece], place[one]


def windows(texts: list[tuple[int, str]], q: int, size: int, rate: float) -> list[Windows]:
    """Indexes that hold all pieces of the texts with ``q`` bytes and more. A piece of m bytes within k edits shares
    m - q + 1 - k * q grams, which must be one at least: texts too short for that with grams of q bytes (there are none
    with a budget of 0) stand in an index of shorter grams."""
    step, short, rest = max(1, int(size * rate)), [], []
    for key, text in texts:
        raw, offsets = buffers(pa.array([text], pa.large_string()))
        m = min(len(normalise(raw, offsets)[0].tobytes().strip()), size)
        (rest if m - q + 1 - q * int(m * rate) >= 1 else short if m >= q else []).append((key, text))
    least = min((m - int(m * rate)) // (int(m * rate) + 1) for m in range(q, size + 1))
    return [Windows(own, n, size, rate, step) for own, n in ((rest, q), (short, max(1, min(q // 2, least)))) if own]


def _cover(parts: list) -> tuple[int, int, int, int]:
    """Covered bytes, edits, and span from the first to the last of parts (begin and end in the key's text, edits, span)."""
    covered = reach = edits = k = 0
    parts = sorted(parts)
    while k < len(parts):  # the fewest pieces that cover as much, for edits are not to be counted over and over
        while k + 1 < len(parts) and parts[k][0] <= reach and parts[k + 1][0] <= reach:
            k += 1
        a, b, own_edits = parts[k][:3]
        if b > reach:
            covered += b - max(a, reach)
            edits += own_edits
            reach = b
        k += 1
    return covered, edits, min(x[3] for x in parts), max(x[4] for x in parts)


def matches(index: Patterns, texts: pa.Array, found, reach: float | None = None) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(text, key) -> covered bytes of the key's text, edits, and the span of the text from the first to the last match.
    reach: only pieces that stand within so many times the key's length of each other add up; the place that covers most
    is told, the first if tied."""
    by: dict[tuple[int, int], list] = {}
    for t, p, e, s, x in zip(*(c.tolist() for c in found)):
        by.setdefault((t, int(index.owner[p])), []).append((s, x, e, p))
    done = {}
    for own, spots in sorted(by.items()):
        spots.sort()
        limit = float("inf") if reach is None else reach * index.total[own[1]] + 64
        best, a = None, 0
        for b in range(len(spots)):
            while spots[b][1] - spots[a][0] > limit and a < b:
                a += 1
            if b + 1 < len(spots) and spots[b + 1][1] - spots[a][0] <= limit:
                continue  # the next place holds these as well
            least: dict[int, tuple] = {}
            for s, x, e, p in spots[a : b + 1]:
                least[p] = min(least.get(p, (e, s, x)), (e, s, x))
            told = _cover([(int(index.start[p]), int(index.start[p] + index.length[p]), *v) for p, v in least.items()])
            if best is None or (told[0], -told[1]) > (best[0], -best[1]):
                best = told
        done[own] = best
    return done
