"""Cards of many plain pages at a time: tags, tree and selectors as arrays over all of the pages, with the results of `dom`.

A page is plain if it holds nothing but plain tags, properly nested, without scripts, elements of rules of their own and elements that a parser may have to
end by itself. Its tree then follows from counting tags: a node's descendants and its text stand between its two tags. All other pages are left to `dom.parse`.
"""

from __future__ import annotations

import html

import numpy as np
import pyarrow as pa

from merchlake.functions import dom

NODE, OPEN, CLOSE, ODD = 0, 1, 2, 3  # a node without content; the two tags of one with content; what only dom reads
_BY_ITSELF = frozenset(name for ends in dom.IMPLIED.values() for name in ends)
#: Different tags that a reader keeps.
TAGS_KEPT = 20_000


def _items(offsets: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class _Tag:
    """What a tag says, in the members of a node that a step without a place tests."""

    __slots__ = ("kind", "tag", "attrs", "classes", "number", "steps")


class _Tags:
    """Tags by their text, numbers of their names, and the steps of the selectors that each fits."""

    def __init__(self, selectors):
        self.known: dict[bytes, _Tag] = {}
        self.numbers: dict[str, int] = {}
        self.compiled, self.steps, by_key = {}, [], {}
        for selector in selectors:
            self.compiled[selector] = groups = []
            for steps, _ in dom._compile(selector):
                groups.append([*range(len(self.steps), len(self.steps) + len(steps))])
                self.steps += steps
        for k, step in enumerate(self.steps):
            by_key.setdefault(step.keys[0], []).append(k)
        self.by_key = by_key

    def __getitem__(self, text: bytes) -> _Tag:
        tag = self.known.get(text)
        if tag is None:
            if len(self.known) >= TAGS_KEPT:
                self.known.clear()
            tag = self.known[text] = self._read(text)
        return tag

    def _read(self, text: bytes) -> _Tag:
        out = _Tag()
        out.kind, out.tag, out.attrs, out.classes, out.number, out.steps = ODD, "", {}, (), -1, ()
        if (found := dom._TAG.fullmatch(f"<{text.decode()}>")) is None:
            return out
        end, name, attributes, empty = found.groups()
        out.tag = name = name.lower()
        out.number = self.numbers.setdefault(name, len(self.numbers))
        if end:
            if not (attributes or empty or name in dom.VOID):
                out.kind = CLOSE
            return out
        if name in dom.RAW or name in dom._OWN_RULES or name in _BY_ITSELF:
            return out
        out.kind = NODE if empty or name in dom.VOID else OPEN
        if attributes:
            out.attrs = {k.lower(): html.unescape(v) if "&" in v else v for k, v1, v2 in dom._ATTRIBUTE.findall(attributes) for v in (v1 or v2,)}
            if "class" in out.attrs:
                out.classes = out.attrs["class"].split()
        keys = [("tag", name), ("any", ""), *(("attr", a) for a in out.attrs), *(("cls", c) for c in dict.fromkeys(out.classes))]
        if "id" in out.attrs:
            keys.append(("id", out.attrs["id"]))
        out.steps = [k for key in keys for k in self.by_key.get(key, ()) if dom._fits(out, self.steps[k])]
        return out


class Cards:
    """Reads the heads and cards of pages: heads and fields as (selectors, attribute), as in `extract`."""

    def __init__(self, card: str, fields: dict, heads: dict, exists: str):
        self.card, self.fields, self.heads, self.exists = card, fields, heads, exists
        self.tags = _Tags(dict.fromkeys([card, *(s for selectors, _ in [*fields.values(), *heads.values()] for s in selectors or ())]))

    @staticmethod
    def fit(card: str, fields: dict, heads: dict) -> bool:
        """Whether the selectors look at nothing but what stands in a tag and above it."""
        every = [card, *(s for selectors, _ in [*fields.values(), *heads.values()] for s in selectors or ())]
        steps = [step for s in every for group, _ in dom._compile(s) for step in group]
        return all(selectors is not None for selectors, _ in heads.values()) and not any(step.adjacent or any("place" in t for t in step.tests) for step in steps)

    def read(self, pages: pa.Array):
        """For the plain ones of pages (null: empty): their numbers, values of each head, numbers of cards, and of all cards in order the values of each field."""
        pages = pages.cast(pa.large_binary()).fill_null(b"")
        buffers = pages.buffers()
        bounds = np.frombuffer(buffers[1], np.int64, len(pages) + 1, pages.offset * 8)
        data = np.frombuffer(buffers[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        plain = np.ones(len(pages), bool)
        # one tag after the other, with no other signs between them
        left, right = np.flatnonzero(data == 60), np.flatnonzero(data == 62)
        n_left, n_right = (np.diff(np.searchsorted(side, bounds)) for side in (left, right))
        plain &= n_left == n_right
        page = np.repeat(np.arange(len(pages)), n_left)
        left, page, right = left[plain[page]], page[plain[page]], right[np.repeat(plain, n_right)]
        wrong = left >= right
        wrong[:-1] |= (right[:-1] > left[1:]) & (page[:-1] == page[1:])
        plain[page[wrong]] = False
        kept = plain[page]
        left, right, page = left[kept], right[kept], page[kept]
        # what each tag says
        inner = _items(np.column_stack((left + 1, right)).ravel(), data).take(pa.array(np.arange(0, 2 * len(left) - 1, 2))) if len(left) else pa.array([], pa.large_binary())
        coded = inner.dictionary_encode()
        said, code = [self.tags[text] for text in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False)
        kind = np.array([t.kind for t in said], np.int8)[code]
        plain[page[kind == ODD]] = False
        # the tags of each page nest: the depth never falls below 0, ends at 0, and what opens at a depth is closed at it by the same name
        deep = np.cumsum((kind == OPEN).astype(np.int64) - (kind == CLOSE))
        count = np.bincount(page, minlength=len(pages))
        ends = np.cumsum(count)
        total = np.concatenate(([0], deep))
        deep -= np.repeat(total[ends - count], count)
        plain[page[deep < 0]] = False
        plain &= total[ends] == total[ends - count]
        kept = plain[page]
        left, right, page, code, kind, deep = left[kept], right[kept], page[kept], code[kept], kind[kept], deep[kept]
        paired = np.flatnonzero(kind != NODE)
        level = deep[paired] + (kind[paired] == CLOSE)
        order = paired[np.argsort(page[paired] * (level.max(initial=0) + 1) + level, kind="stable")]
        opens, closes = order[0::2], order[1::2]
        name = np.array([t.number for t in said], np.int64)
        plain[page[opens[name[code[opens]] != name[code[closes]]]]] = False
        shut = np.arange(len(left))
        shut[opens] = closes
        # the text after each tag, up to the next one of its page
        after = np.append(left[1:], 0)
        last = np.append(page[1:] != page[:-1], True)[: len(page)]
        after = np.where(last, right + 1, after[: len(right)])
        texts = _items(np.column_stack((right + 1, after)).ravel(), data).take(pa.array(np.arange(0, 2 * len(left) - 1, 2))) if len(left) else pa.array([], pa.large_binary())
        start = np.frombuffer(texts.buffers()[1], np.int64, len(left) + 1, texts.offset * 8) if len(left) else np.zeros(1, np.int64)
        text = np.frombuffer((texts.buffers()[2] if len(left) else None) or b"", np.uint8)[start[0] : start[-1]]
        self._said, self._code, self._shut, self._start, self._text, self._bytes = said, code, shut, start - start[0], text, text.tobytes()
        # signs before each place that keep a text from being taken as it stands: white space but single blanks, references, what isn't ASCII
        odd = (text < 32) | (text > 126) | (text == 38)
        odd[1:] |= (text[1:] == 32) & (text[:-1] == 32)
        self._odd_before = np.append(0, np.cumsum(odd))
        # which tags fit which steps
        fits: dict[int, list[int]] = {}
        for k, t in enumerate(said):
            for step in t.steps:
                fits.setdefault(step, []).append(k)
        self._fits = fits
        self._matches = {}
        numbers = np.flatnonzero(plain)
        count = np.bincount(page, minlength=len(pages))
        ends = np.cumsum(count)
        heads = {k: self._values(ends[numbers] - count[numbers] - 1, ends[numbers], *v) for k, v in self.heads.items()}
        cards = self._match(self.card)
        cards = cards[plain[page[cards]]]
        fields = {k: self._values(cards, shut[cards], *v) for k, v in self.fields.items()}
        return numbers, heads, np.bincount(page[cards], minlength=len(pages))[numbers], fields

    def _match(self, selector: str) -> np.ndarray:
        """Places of the tags that begin a match, rising."""
        if selector in self._matches:
            return self._matches[selector]
        said, code, shut = self._said, self._code, self._shut
        found = []
        for group in self.tags.compiled[selector]:
            matches = None
            for step in group:
                if step not in self._fits:
                    break
                fit = np.zeros(len(said), bool)
                fit[self._fits[step]] = True
                at = np.flatnonzero(fit[code])
                if matches is not None:  # within a match of the steps before
                    at = at[np.searchsorted(matches, at) > np.searchsorted(np.sort(shut[matches]), at)]
                matches = at
            else:
                found.append(matches)
        out = self._matches[selector] = found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return out

    def _values(self, low: np.ndarray, high: np.ndarray, selectors, attribute) -> pa.Array:
        """A value for each range of tags (both ends left out): of the first match, in order of selectors, that has one."""
        if selectors is None:
            return self._of(low, attribute)
        places, values = [], []
        left = np.arange(len(low))  # the ranges without a value
        for selector in selectors:
            matches = self._match(selector)
            if not len(matches) or not len(left):
                continue
            at, end = np.searchsorted(matches, low[left], "right"), np.searchsorted(matches, high[left])
            blank, trying = [left[at >= end]], left[at < end]
            at, end = at[at < end], end[at < end]
            while len(trying):
                found = pa.array(["1"] * len(trying)) if attribute == self.exists else self._of(matches[at], attribute)
                there = found.is_valid().to_numpy(zero_copy_only=False)
                places.append(trying[there])
                values.append(found.drop_null())
                trying, at, end = trying[~there], at[~there] + 1, end[~there]
                blank.append(trying[at >= end])
                trying, at, end = trying[at < end], at[at < end], end[at < end]
            left = np.sort(np.concatenate(blank))
        back = np.full(len(low), -1)
        if places:
            every = np.concatenate(places)
            back[every] = np.arange(len(every))
        return pa.concat_arrays([pa.array([], pa.string()), *values]).take(pa.array(back, mask=back < 0))

    def _of(self, tags: np.ndarray, attribute) -> pa.Array:
        """Text or attribute of the nodes of the tags, blank ones null."""
        if attribute:
            numbers, back = np.unique(self._code[tags], return_inverse=True)
            return pa.array([(self._said[k].attrs.get(attribute) or "").strip() or None for k in numbers.tolist()], pa.string()).take(pa.array(back))
        start, text, odd = self._start, self._text, self._odd_before
        begin, end = start[tags], start[self._shut[tags]]
        plain = (odd[begin] == odd[end]) & (begin < end)
        if len(begin) and plain.all() and (begin[1:] >= end[:-1]).all():  # as they stand, one after the other
            spans = np.column_stack((begin, end)).ravel()
            edges = text[begin], text[end - 1]
            if not ((edges[0] == 32) | (edges[1] == 32)).any():
                return _items(spans, text).take(pa.array(np.arange(0, len(spans) - 1, 2))).cast(pa.string())
        parts = []
        for tag, a, b in zip(tags.tolist(), begin.tolist(), end.tolist()):
            part = self._bytes[a:b].decode()
            if "&" in part:  # each run of text is read by itself
                at = start[tag : self._shut[tag] + 1].tolist()
                part = "".join(html.unescape(self._bytes[x:y].decode()) for x, y in zip(at, at[1:]))
            parts.append(" ".join(part.split()) or None)
        return pa.array(parts, pa.string())
