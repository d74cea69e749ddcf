"""External induced suffix sorting with common prefixes, to a bounded depth.

The text is a sequence of segments. Suffixes whose first character is larger than their second are
L-type, the others S-type; an S-type one after an L-type one is a seed. Seeds are sorted first: the
strings between neighbouring seeds get names in their order, and the string of names is sorted in its
turn, by the same procedure, until it fits into memory. Then a scan by rising order induces the L-type
suffixes from the seeds, and a scan by falling order the S-type ones from those. A scanned suffix puts
its predecessor into a priority queue whose key is (first character, order of the scanned suffix). The
second part only ever rises, so the queue is cut into ranges of characters: the range at hand is in
memory with a place for each of its suffixes, every later one is a spool on disk in the order of the
puts, and a single character with too many suffixes is its spool, read in order. What is put carries
its position and its common prefix with what was put there before, which is one more than the least
common prefix between the suffixes that put the two.

Arrays as long as a level's text are files beyond `budget` entries, and so is the text itself if its
caller made it so; memory holds a few times `budget` entries and one batch, at any length of the text.
The files are scratch of the task that sorts and go with it.

Everything is sorted to `depth` characters only; suffixes equal that far are neighbours in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Entries that a level of the recursion holds in memory, and entries of one batch of a scan.
BUDGET, BATCH = 1 << 21, 1 << 17


class Scratch:
    """Arrays in memory up to `budget` entries, in files of a temporary folder beyond."""

    def __init__(self, budget: int = BUDGET, batch: int = BATCH):
        self.budget, self.batch, self.folder, self.made = budget, min(batch, budget), None, 0

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="suffixes-")
        self.made += 1
        return os.path.join(self.folder, str(self.made))

    def array(self, size: int, kind) -> np.ndarray:
        if size <= self.budget:
            return np.zeros(size, kind)
        return np.memmap(self.path(), kind, "w+", shape=(size,))

    def spool(self) -> Spool:
        return Spool(self)

    def drop(self, *arrays: np.ndarray) -> None:
        """Removes the files of arrays that are used no more."""
        for a in arrays:
            if isinstance(a, np.memmap) and os.path.exists(a.filename):
                os.remove(a.filename)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)


class Spool:
    """A first-in-first-out file of (position, common prefix) pairs; a small one stays in memory."""

    RECORD = np.dtype([("at", "<i8"), ("lcp", "u1")])

    def __init__(self, scratch: Scratch):
        self.scratch, self.path, self.parts, self.held, self.written = scratch, None, [], 0, 0

    def put(self, at: np.ndarray, lcp: np.ndarray) -> None:
        part = np.empty(len(at), self.RECORD)
        part["at"], part["lcp"] = at, lcp
        self.parts.append(part)
        self.held += len(part)
        if self.held > self.scratch.batch // 8:
            self.path = self.path or self.scratch.path()
            with open(self.path, "ab") as file:
                for part in self.parts:
                    part.tofile(file)
            self.written += self.held
            self.parts, self.held = [], 0

    def __len__(self) -> int:
        return self.written + self.held

    def read(self, begin: int, end: int) -> np.ndarray:
        pieces = []
        if begin < self.written:
            pieces.append(np.fromfile(self.path, self.RECORD, min(end, self.written) - begin, offset=begin * self.RECORD.itemsize))
        if end > self.written:
            memory = np.concatenate([*self.parts, np.empty(0, self.RECORD)])
            pieces.append(memory[max(begin - self.written, 0) : end - self.written])
        return np.concatenate([*pieces, np.empty(0, self.RECORD)])

    def clear(self) -> None:
        if self.path is not None:
            os.remove(self.path)
        self.path, self.parts, self.held, self.written = None, [], 0, 0


def slices(size: int, step: int) -> Iterator[tuple[int, int]]:
    for a in range(0, size, step):
        yield a, min(a + step, size)


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]), both included, for each pair."""
    out = np.empty(len(first), values.dtype)
    width = np.frexp(last - first + 1)[1] - 1
    table, level = values, 0
    for wanted in range(int(width.max(initial=0)) + 1):
        while level < wanted:
            table = np.minimum(table[: len(table) - (1 << level)], table[1 << level :])
            level += 1
        own = np.flatnonzero(width == wanted)
        out[own] = np.minimum(table[first[own]], table[last[own] - (1 << wanted) + 1])
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, limits: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to depth, or up to a limit for each."""
    out = np.zeros(len(a), np.uint8)
    alive = np.arange(len(a))
    for k in range(depth):
        if limits is not None:
            alive = alive[limits[alive] > k]
        x, y = a[alive] + k, b[alive] + k
        inside = (x < len(text)) & (y < len(text))
        alive = alive[inside]
        alive = alive[text[x[inside]] == text[y[inside]]]
        if not len(alive):
            break
        out[alive] += 1
    return out


def types_of(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """True for S-type positions; the last one is S-type (its character is the smallest)."""
    is_s = scratch.array(len(text), bool)
    is_s[-1] = True
    stop = len(text) - 1
    while stop > 0:
        start = max(0, stop - scratch.batch)
        own = np.asarray(text[start : stop + 1])
        differs = np.flatnonzero(own[1:] != own[:-1])
        following = np.searchsorted(differs, np.arange(stop - start))
        settled = following < len(differs)
        # A run of one character that goes on beyond the batch is as its end is.
        at = differs[np.minimum(following, len(differs) - 1)] if len(differs) else np.zeros(stop - start, np.int64)
        is_s[start:stop] = np.where(settled, own[at] < own[at + 1], is_s[stop])
        stop = start
    return is_s


def seeds_of(is_s: np.ndarray, scratch: Scratch) -> np.ndarray:
    found = lambda a, b: np.flatnonzero(is_s[max(a, 1) : b] & ~is_s[max(a, 1) - 1 : b - 1]) + max(a, 1)
    total = sum(len(found(a, b)) for a, b in slices(len(is_s), scratch.batch))
    seeds, done = scratch.array(total, np.int64), 0
    for a, b in slices(len(is_s), scratch.batch):
        own = found(a, b)
        seeds[done : done + len(own)] = own
        done += len(own)
    return seeds


class Names:
    """Names of the strings from each seed to the next one, to depth: the number of smaller strings."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, characters: int, depth: int, scratch: Scratch):
        self.text, self.is_s, self.seeds, self.depth, self.scratch = text, is_s, seeds, depth, scratch
        self.bits = max(10, (2 * characters + 2).bit_length())
        self.each = max(1, 60 // self.bits)
        self.names = scratch.array(len(seeds), np.int64)

    def keys(self, own: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        """The next few (character, type) symbols of strings as one number, and whether more follow."""
        start = self.seeds[own] + offset
        after = np.minimum(own + 1, len(self.seeds) - 1)
        ends = np.where(own + 1 < len(self.seeds), self.seeds[after], len(self.text) - 1)
        key = np.zeros(len(own), np.uint64)
        for k in range(self.each):
            inside = start + k <= ends
            at = np.minimum(start + k, len(self.text) - 1)
            symbol = self.text[at].astype(np.uint64) * np.uint64(2) + self.is_s[at] + np.uint64(1)
            key = key << np.uint64(self.bits) | np.where(inside, symbol, np.uint64(0))
        return key, start + self.each <= ends

    def small(self, own: np.ndarray, offset: int, before: int) -> None:
        """Names of a set of seeds that fits into memory; strings are equal up to offset."""
        name = np.zeros(len(own), np.int64)
        active = np.arange(len(own))
        while len(active) and offset <= self.depth:
            key, more = self.keys(own[active], offset)
            order = np.lexsort((key, name[active]))
            ids, keys = name[active][order], key[order]
            new_key = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
            new_id = np.append(True, ids[1:] != ids[:-1])
            # A name is the number of strings before its group: refining it keeps the other names.
            places = np.arange(len(order))
            group = np.maximum.accumulate(np.where(new_id, places, 0))
            inner = np.maximum.accumulate(np.where(new_key, places, 0)) - group
            name[active[order]] = ids + inner
            alone = new_key & np.append(new_key[1:], True)
            active = np.sort(active[order][~alone & more[order]])
            offset += self.each
        self.names[own] = name + before

    def find(self) -> np.ndarray:
        """Sets beyond the budget are dealt by ranges of the next key, then each in its turn."""
        budget, batch = self.scratch.budget, self.scratch.batch
        todo: list[tuple[Spool | None, int, int, int]] = [(None, len(self.seeds), 0, 0)]
        while todo:
            spool, size, offset, before = todo.pop()
            read = (lambda a, b, s=spool: s.read(a, b)["at"]) if spool is not None else (lambda a, b: np.arange(a, b))
            if size <= budget:
                self.small(read(0, size), offset, before)
            elif offset > self.depth:
                for a, b in slices(size, batch):
                    self.names[read(a, b)] = before
            else:
                step = max(1, size // (4 * batch))
                some = np.concatenate([self.keys(read(a, b)[::step], offset)[0] for a, b in slices(size, batch)])
                ways = 2 * -(-size // budget)
                cuts = np.unique(np.quantile(some, np.linspace(0, 1, ways + 1)[1:-1], method="nearest"))
                # Between the cuts, and on each: equal keys stay together.
                parts = [self.scratch.spool() for _ in range(2 * len(cuts) + 1)]
                ended = np.zeros(len(parts), bool)
                for a, b in slices(size, batch):
                    own = read(a, b)
                    key, more = self.keys(own, offset)
                    place = np.searchsorted(cuts, key, "left")
                    on = (place < len(cuts)) & (cuts[np.minimum(place, len(cuts) - 1)] == key)
                    place = 2 * place + on
                    order = np.argsort(place, kind="stable")
                    heads = np.searchsorted(place[order], np.arange(len(parts) + 1))
                    for p in np.flatnonzero(np.diff(heads)):
                        chosen = order[heads[p] : heads[p + 1]]
                        parts[p].put(own[chosen], np.zeros(len(chosen), np.uint8))
                        ended[p] |= not more[chosen[0]]
                for p, part in enumerate(parts):
                    if len(part):
                        # One key: go on behind it, or, where it ends the strings, they are equal.
                        further = (self.depth + 1 if ended[p] else offset + self.each) if p % 2 else offset
                        todo.append((part, len(part), further, before))
                        before += len(part)
            if spool is not None:
                spool.clear()
        return self.names


def by_doubling(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before, up to depth) of a string's suffixes, in memory: each
    round orders by twice as many names."""
    rank, step, rounds = names, 1, [names]
    while step < min(len(rank), depth):
        key = rank * (len(rank) + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        step *= 2
        rounds.append(rank)
        if new.all():
            break
    order = np.argsort(rank, kind="stable")
    # Equal ranks of a round are equal runs of names: the common prefix by halves.
    a, b = order[:-1], order[1:]
    same = np.zeros(len(a), np.int64)
    for k in reversed(range(len(rounds))):
        x, y = a + same, b + same
        # A run that meets the end of the string is shorter than the round's length.
        equal = np.maximum(x, y) + (1 << k) <= len(names)
        equal[equal] = rounds[k][x[equal]] == rounds[k][y[equal]]
        same += np.where(equal, 1 << k, 0)
    return order, np.append(0, np.minimum(same, depth)).astype(np.uint8)


def sort_seeds(text: np.ndarray, is_s: np.ndarray, characters: int, depth: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Seeds in the order of their suffixes, to at least depth characters, and the common prefix of
    each with the one before (up to depth)."""
    seeds = seeds_of(is_s, scratch)
    if len(seeds) < 2:
        return seeds, np.zeros(len(seeds), np.uint8)
    names = Names(text, is_s, seeds, characters, depth, scratch).find()
    # A string between seeds is two characters at least, so half as many names as characters do.
    inner = depth // 2 + 1
    if len(seeds) <= scratch.budget:
        order, same = by_doubling(names, inner)
    else:
        order, same, done = scratch.array(len(seeds), np.int64), scratch.array(len(seeds), np.uint8), 0
        for at, lcp in induced(names, len(seeds), inner, scratch):
            order[done : done + len(at)], same[done : done + len(at)] = at, lcp
            done += len(at)
    sorted_seeds, lcp = scratch.array(len(seeds), np.int64), scratch.array(len(seeds), np.uint8)
    edge = lambda i: np.where(i < len(seeds), seeds[np.minimum(i, len(seeds) - 1)], len(text))
    for a, b in slices(len(seeds), scratch.batch):
        own = np.asarray(order[a:b])
        sorted_seeds[a:b] = seeds[own]
        x, y, names_in_common = order[max(a, 1) - 1 : b - 1], order[max(a, 1) : b], same[max(a, 1) : b].astype(np.int64)
        # The characters of the names in common, then those within the first names that differ.
        head = np.minimum(edge(x + names_in_common) - seeds[x], edge(y + names_in_common) - seeds[y])
        total = np.full(len(x), depth, np.int64)
        near = np.flatnonzero(head < depth)
        total[near] = head[near] + common_prefix(text, seeds[x[near]] + head[near], seeds[y[near]] + head[near], depth, depth - head[near])
        lcp[max(a, 1) : b] = total
    scratch.drop(seeds, names, order, same)
    return sorted_seeds, lcp


class Scan:
    """One induced scan over the ranges of characters, by rising `symbol` (characters, or turned ones).

    In a symbol's turn first the suffixes come that were put, in the order of the puts, then the fixed
    ones, whose sorted order is known. put_counts and fixed_counts: how many of each a symbol has.
    fixed(a, b) gives those from place a to b in scan order with their common prefixes.
    """

    def __init__(self, text: np.ndarray, depth: int, scratch: Scratch, symbol: Callable, put_counts: np.ndarray, fixed_counts: np.ndarray, fixed: Callable, puts: Callable, end: int | None):
        self.text, self.depth, self.scratch, self.symbol, self.fixed, self.puts, self.end = text, depth, scratch, symbol, fixed, puts, end
        self.put_counts, self.fixed_counts = put_counts, fixed_counts
        self.bounds = ranges(put_counts, fixed_counts, scratch)
        self.spools = [scratch.spool() for _ in range(len(self.bounds) - 1)]
        self.least = np.zeros(len(self.spools), np.uint8)
        total = int(sum(int(put_counts[a:b].sum()) for a, b in slices(len(put_counts), scratch.batch)))
        self.at, self.lcp, self.done = scratch.array(total, np.int64), scratch.array(total, np.uint8), 0

    def store(self, at: np.ndarray, lcp: np.ndarray) -> None:
        self.at[self.done : self.done + len(at)], self.lcp[self.done : self.done + len(at)] = at, lcp
        self.done += len(at)

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return common_prefix(self.text, np.asarray(a, np.int64), np.asarray(b, np.int64), self.depth)

    def predecessors(self, at: np.ndarray, lcp: np.ndarray, of: Callable, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, target, least common prefix since the target's last put) of what a run of scanned
        suffixes puts, by target; brings `least` (for each target) up to date. of: target of symbols;
        negative ones are left out."""
        sources = np.flatnonzero(self.puts(at))
        whole = lcp.min()
        targets = of(self.symbol(self.text[at[sources] - 1])) if len(sources) else np.empty(0, np.int64)
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        if not len(sources):
            np.minimum(least, whole, out=least)
            return sources, targets, np.empty(0, np.uint8)
        order = np.argsort(targets, kind="stable")
        targets, sources = targets[order], sources[order]
        first = np.append(True, targets[1:] != targets[:-1])
        before = np.append(-1, sources[:-1])
        before[first] = -1
        found = least_between(lcp, before + 1, sources)
        found[first] = np.minimum(found[first], least[targets[first]])
        np.minimum(least, whole, out=least)
        last = np.append(first[1:], True)
        tail = np.append(lcp, np.uint8(255))
        least[targets[last]] = least_between(tail, sources[last] + 1, np.full(int(last.sum()), len(lcp)))
        return at[sources] - 1, targets, found

    def more(self, lcp: np.ndarray) -> np.ndarray:
        return np.minimum(lcp.astype(np.int64) + 1, self.depth).astype(np.uint8)

    def put_later(self, at: np.ndarray, lcp: np.ndarray, current: int) -> None:
        """Puts what belongs to later ranges (and, to a range of one symbol, what belongs to itself)."""

        def of(symbols: np.ndarray) -> np.ndarray:
            part = np.searchsorted(self.bounds, symbols, "right") - 1
            return np.where(part >= current, part, -1)

        places, parts, found = self.predecessors(at, lcp, of, self.least)
        heads = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else parts
        for a, b in zip(heads, np.append(heads, len(parts))[1:], strict=True):
            self.spools[int(parts[a])].put(places[a:b], found[a:b])

    def run(self) -> Scan:
        fixed_done = 0
        for p in range(len(self.spools)):
            lo, hi = int(self.bounds[p]), int(self.bounds[p + 1])
            fixed_size = int(np.asarray(self.fixed_counts[lo:hi]).sum())
            if hi - lo == 1 and int(self.put_counts[lo]) + fixed_size > self.scratch.budget:
                self.one_symbol(p, lo, fixed_done, fixed_size)
            else:
                self.many_symbols(p, lo, hi, fixed_done, fixed_size)
            self.spools[p].clear()
            fixed_done += fixed_size
        return self

    def one_symbol(self, p: int, symbol: int, fixed_done: int, fixed_size: int) -> None:
        spool, done, last = self.spools[p], 0, None

        def scan(at: np.ndarray, lcp: np.ndarray) -> None:
            nonlocal last
            lcp = lcp.copy()
            lcp[0] = 0 if last is None else self.meet([last], at[:1])[0]
            self.put_later(at, lcp, p)
            last = int(at[-1])

        while done < (size := len(spool)):
            for a, b in slices(size - done, self.scratch.batch):
                batch = spool.read(done + a, done + b)
                at, lcp = batch["at"], self.more(batch["lcp"])
                self.store(at, lcp)
                scan(at, lcp)
            done = size
        if self.end is not None and symbol == self.symbol(self.text[self.end : self.end + 1])[0]:
            final = np.array([self.end])
            self.store(final, self.meet([last], final) if last is not None else np.zeros(1, np.uint8))
            scan(final, np.zeros(1, np.uint8))
        for a, b in slices(fixed_size, self.scratch.batch):
            scan(*self.fixed(fixed_done + a, fixed_done + b))

    def many_symbols(self, p: int, lo: int, hi: int, fixed_done: int, fixed_size: int) -> None:
        put_counts, fixed_counts = (np.asarray(c[lo:hi]).astype(np.int64) for c in (self.put_counts, self.fixed_counts))
        sizes = put_counts + fixed_counts
        begin = np.cumsum(sizes) - sizes
        slots, common = np.full(int(sizes.sum()), -1, np.int64), np.zeros(int(sizes.sum()), np.uint8)
        own = np.zeros(len(slots), bool)  # places of what is put
        own[np.repeat(begin, put_counts) + _count_up(put_counts)] = True
        fixed_at, fixed_lcp = self.fixed(fixed_done, fixed_done + fixed_size)
        slots[~own], common[~own] = fixed_at, fixed_lcp
        pointer, least = begin.copy(), np.zeros(hi - lo, np.uint8)
        # What was put before the range's turn.
        spool = self.spools[p].read(0, len(self.spools[p]))
        if len(spool):
            at, carried = spool["at"], spool["lcp"]
            number = self.symbol(self.text[at]).astype(np.int64) - lo
            order = np.argsort(number, kind="stable")
            first = np.append(True, number[order][1:] != number[order][:-1])
            before = np.append(-1, order[:-1])
            before[first] = -1
            counts = np.bincount(number, minlength=hi - lo)
            places = np.repeat(pointer, counts) + _count_up(counts)
            slots[places] = at[order]
            common[places] = self.more(least_between(carried, before + 1, order))
            pointer += counts
            last = np.append(first[1:], True)
            rest = np.append(np.minimum.accumulate(carried[::-1])[::-1], np.uint8(255))
            least[number[order][last]] = np.minimum(rest[order[last] + 1], self.least[p])
        if self.end is not None and lo <= (c := int(self.symbol(self.text[self.end : self.end + 1])[0])) < hi:
            slots[begin[c - lo] + put_counts[c - lo] - 1] = self.end
        begin_of_symbol = np.zeros(len(slots), bool)
        begin_of_symbol[begin[sizes > 0]] = True
        checked = begin + put_counts
        checked = checked[(put_counts > 0) & (fixed_counts > 0)]
        compare = np.zeros(len(slots), bool)
        compare[checked] = True
        if self.end is not None and lo <= c < hi:
            compare[begin[c - lo] + put_counts[c - lo] - 1] = True
        s = 0

        def here(symbols: np.ndarray) -> np.ndarray:
            return np.where((symbols >= lo) & (symbols < hi), symbols.astype(np.int64) - lo, -1)

        while s < len(slots):
            # The run of filled places: their order is final.
            e, step = s, 1 << 12
            while e < min(len(slots), s + self.scratch.batch):
                stop = min(e + step, len(slots))
                empty = np.flatnonzero(slots[e:stop] < 0)
                if len(empty):
                    e += int(empty[0])
                    break
                e, step = stop, step * 2
            if e == s:
                raise AssertionError("a suffix was never put")
            at, lcp = slots[s:e], common[s:e]
            lcp[begin_of_symbol[s:e]] = 0
            spots = np.flatnonzero(compare[s:e] & ~begin_of_symbol[s:e])
            if len(spots):
                lcp[spots] = self.meet(slots[s + spots - 1], at[spots])
            self.put_later(at, lcp, p + 1)
            places, symbols, found = self.predecessors(at, lcp, here, least)
            if len(places):
                counts = np.bincount(symbols, minlength=0)
                some = np.flatnonzero(counts)
                target = pointer[symbols] + _count_up(counts[some])
                slots[target], common[target] = places, self.more(found)
                pointer[some] += counts[some]
            s = e
        self.store(slots[own], common[own])


def _count_up(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def ranges(one: np.ndarray, two: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Bounds of ranges of symbols with `budget` entries at most, or one symbol."""
    bounds, held = [0], 0
    for a, b in slices(len(one), scratch.batch):
        sizes = np.asarray(one[a:b]).astype(np.int64) + two[a:b]
        total, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            gone = total[begin - 1] if begin else 0
            # The next symbol that the open range has no room for.
            at = int(np.searchsorted(total, gone + scratch.budget - held, "right"))
            if at >= len(sizes):
                held += int(total[-1] - gone)
                break
            if a + at > bounds[-1]:
                bounds.append(a + at)
            held = 0
            begin = at
            if sizes[at] > scratch.budget:
                bounds.append(a + at + 1)
                begin = at + 1
    if bounds[-1] < len(one):
        bounds.append(len(one))
    return np.array(bounds, np.int64)


def histograms(text: np.ndarray, is_s: np.ndarray, characters: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of L-type, S-type and seed positions of each character."""
    out = tuple(scratch.array(characters, np.int64) for _ in range(3))
    for a, b in slices(len(text), scratch.batch):
        own, s = np.asarray(text[a:b]), np.asarray(is_s[a:b])
        seed = s & ~np.append(is_s[a - 1] if a else True, s[:-1])
        for counts, chosen in zip(out, (~s, s, seed), strict=True):
            value, n = np.unique(own[chosen], return_counts=True)
            counts[value] += n
    return out


def induced(text: np.ndarray, characters: int, depth: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (positions, common prefix with the position before, up to depth) in suffix order.

    text: numbers below `characters`; the last one is the smallest and differs from the one before it.
    """
    is_s = types_of(text, scratch)
    seeds, seed_lcp = sort_seeds(text, is_s, characters, depth, scratch)
    l_counts, s_counts, seed_counts = histograms(text, is_s, characters, scratch)

    def puts_l(at: np.ndarray) -> np.ndarray:
        out = at > 0
        out[out] = ~is_s[at[out] - 1]
        return out

    def puts_s(at: np.ndarray) -> np.ndarray:
        out = at > 0
        before = at[out] - 1
        out[out] = is_s[before] & (text[before] <= text[before + 1])
        return out

    up = Scan(text, depth, scratch, lambda c: c, l_counts, seed_counts, lambda a, b: (np.array(seeds[a:b]), np.array(seed_lcp[a:b])), puts_l, None).run()
    scratch.drop(seeds, seed_lcp, seed_counts)
    n = len(up.at)

    def falling(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        # Falling order: the common prefix with the one scanned before is that of the next one up.
        lcp = np.array(up.lcp[n - b + 1 : n - a + 1])[::-1]
        return np.array(up.at[n - b : n - a])[::-1], lcp if a else np.append(np.uint8(0), lcp)

    top = characters - 1
    down = Scan(text, depth, scratch, lambda c: top - c.astype(np.int64), s_counts[::-1], l_counts[::-1], falling, puts_s, len(text) - 1).run()
    m, l_done, s_done, last, last_symbol = len(down.at), 0, 0, -1, -1
    bounds = ranges(l_counts, s_counts, scratch)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        l_size, s_size = int(np.asarray(l_counts[lo:hi]).sum()), int(np.asarray(s_counts[lo:hi]).sum())
        for a, b in slices(l_size + s_size, max(scratch.budget, scratch.batch)):
            # Of one symbol all L-type suffixes come first; several symbols are in one piece.
            x, y = min(a, l_size), min(b, l_size)
            at, lcp = np.array(up.at[l_done + x : l_done + y]), np.array(up.lcp[l_done + x : l_done + y])
            u, v = max(a - l_size, 0), max(b - l_size, 0)
            rising = np.array(down.at[m - s_done - v : m - s_done - u])[::-1]
            above = np.array(down.lcp[m - s_done - v + 1 : m - s_done - u + 1])[::-1]
            if s_done + u == 0 and len(rising):
                above = np.append(np.uint8(0), above)
            at, lcp, s_type = np.append(at, rising), np.append(lcp, above), np.append(np.zeros(y - x, bool), np.ones(v - u, bool))
            symbol = np.asarray(text[at])
            order = np.argsort(symbol, kind="stable")
            at, lcp, s_type, symbol = at[order], lcp[order], s_type[order], symbol[order]
            new = np.append(symbol[:1] != last_symbol, symbol[1:] != symbol[:-1])
            turn = np.append(True, s_type[1:] != s_type[:-1]) & ~new
            previous = np.append(last, at[:-1])
            spots = np.flatnonzero(turn)
            lcp[spots] = common_prefix(text, previous[spots], at[spots], depth)
            lcp[new] = 0
            last, last_symbol = int(at[-1]), symbol[-1]
            yield at, lcp
        l_done += l_size
        s_done += s_size
    scratch.drop(is_s, l_counts, s_counts, up.at, up.lcp, down.at, down.lcp)


def suffix_groups(text: np.ndarray, depth: int, scratch: Scratch | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """induced() of a text of small non-negative integers; 0 ends each segment and must not stand twice
    in a row. depth: 255 at most."""
    if not 0 < depth < 256:
        raise ValueError("depth must be from 1 to 255")
    if len(text):
        with scratch or Scratch() as own:
            characters = max(int(np.asarray(text[a:b]).max()) for a, b in slices(len(text), own.batch)) + 1
            yield from induced(text, characters, depth, own)
