"""Alignment of two tokenizers on the same texts.

Both token sequences spell the same bytes.  A transducer walks them together and
keeps which side leads and by which bytes: the dangling suffix of its last token.
The other side's next token is matched against that suffix, so every step but a
group's first is one link (two tokens with overlapping byte ranges), and a group
closes when nothing dangles.  Short parts take their steps together, in numpy: both
sides have been seen to spell the same bytes, so a state is the number of bytes that
dangle, its sign the side.  Long ones are walked alone, transitions remembered by
state and token.

No token of either side spans a blank between two other characters, so texts fall
apart there and a distinct part is encoded and walked once while it is
remembered.  What a task remembers makes a *chunk*, bounded in parts and in text;
it leaves three kinds of rows: documents (with the parts they hold), the links of
the chunk's parts, and how often each id pair is linked in the chunk.

Corpus-wide counts are sums of the last kind over chunks.  They go back by pair
to the chunks that hold it: a pair has one row in a chunk, so neither a frequent
pair nor a frequent part makes a hot key.  A chunk's documents then meet its
pairs' counts in one task (bounded as the chunk is) and are summed by numpy.
Texts are read once and never sent.

``separable`` proves the cut for the tokenizers at hand (pieces without an inner
blank; probes of the pre-tokenizer); texts of others are walked whole.

Defined cases: a text that is null or empty, or whose tokens of either side spell
other bytes than a blank and the text (a U+2581 in it, for instance), has no
tokens: zeros, and an empty string; it adds nothing to counts.  Strings of special
tokens are plain text.  Long texts are taken in parts of bounded size; rows map
one to one, so repeated rows, null keys and empty tables need nothing; other
columns, whatever their names, never enter the plan.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A chunk closes when it holds so many parts or characters.
PARTS, CHARS = 250_000, 1 << 24
#: Texts are encoded in blocks of so many characters, longer ones in parts of that size.
BLOCK = 1 << 20
#: Transitions remembered before the transducer starts anew.
TRANSITIONS = 1 << 18
#: Parts encoded and walked at once, those that make one text for A's faster library, and the most tokens of a part that isn't walked alone.
AT_ONCE, JOINED, STEPS = 20_000, 256, 64
MARK = "▁"
#: Where both sides end a token: a blank between two characters that aren't white space.
SEAM = re.compile(r" (?<=\S )(?=\S)")
#: A blank beside other white space or at an end, where the seams need a closer look.
UNEVEN = re.compile(r" (?:(?=\s)|(?<=\s )|\Z|(?<=^ ))")
#: How A cuts a text before it merges (fixed value of the format).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters before it have been the same in all versions of Unicode that libraries know.
AFTER_LATIN = "\u0250"
PROBES = ("the end", "a b  c d", " x y", "x y ", "it 's we 'll I'd don't", "1 2 3.5 6", "! ! ?! x", "é è ß\n\n ü ö", "end\nof\tline is", "<s> </s> <|endoftext|> x", "\xa0a \x85 b\x1c c²½ ªº·")
#: White space up to there.
SPACES = [k for k in range(ord(AFTER_LATIN)) if chr(k).isspace()]
DOCUMENT, PARTS_OF_CHUNK, PAIR = 0, 1, 2


def byte_of_sign() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: printable Latin-1 as it is, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ends(lengths: np.ndarray) -> np.ndarray:
    """Where runs of these lengths begin, and the end of the last."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def ordered(values: np.ndarray, lengths: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values``, the k-th of which belongs to ``order[k]`` of ``n``, in the order of what they belong to, and their lengths."""
    starts, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts[order], sizes[order] = ends(lengths)[:-1], lengths
    upto = ends(sizes)
    return values[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)], sizes


def concatenated(table: pa.Array, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The entries ``ids`` of a table of large binaries in a row, and where each begins."""
    found = table.take(pa.array(ids, pa.int64()))
    _, bounds, data = found.buffers()
    return (data.to_pybytes(), np.frombuffer(bounds, np.int64, len(ids) + 1)) if len(ids) else (b"", np.zeros(1, np.int64))


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, lengths.sum()), lengths


def measured(parts: list[str], text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each part with the blank before it, and whether it is of Latin signs without white space at its ends; ``text`` is a blank and each of them."""
    signs = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = ends(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    sizes = np.add.reduceat(1 + (signs > 0x7F) + (signs > 0x7FF) + (signs > 0xFFFF), at[:-1])
    beyond = np.logical_or.reduceat(signs >= ord(AFTER_LATIN), at[:-1])
    return sizes, ~(beyond | np.isin(signs[at[:-1] + 1], SPACES) | np.isin(signs[at[1:] - 1], SPACES))


class Tokenizers:
    """The two tokenizers, and the bytes of their ids.

    Texts of Latin letters are encoded by the same merges in a faster library, where
    the vocabulary allows it (every merge makes the next id) and probes agree.
    """

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        if path_a is None or path_b is None:
            import public_tokenizers

            path_a, path_b = path_a or public_tokenizers.path(FILE_A), path_b or public_tokenizers.path(FILE_B)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = byte_of_sign()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()
        self.bytes_b = [piece(i) for i in range(self.b.get_piece_size())]
        self.lengths_a, self.lengths_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.spelling_a, self.spelling_b = (pa.array(x, pa.large_binary()) for x in (self.bytes_a, self.bytes_b))
        self.fast = self.faster(path_a, vocabulary)

    def faster(self, path: str, vocabulary: dict[str, int]):
        import json

        import tiktoken

        merges = json.load(open(path, encoding="utf-8"))["model"].get("merges", [])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(vocabulary.get("".join(m)) != 256 + k for k, m in enumerate(pairs)):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(pairs))}
        if len(ranks) != 256 + len(pairs) or any(len(self.bytes_a[i]) != 1 for i in range(256)):
            return None
        encode = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        same = all(encode(" " + p) == x.ids for p, x in zip(PROBES, self.a.encode_batch([" " + p for p in PROBES], add_special_tokens=False)))
        return encode if same else None

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        of_a: list = [None] * len(texts)
        slow = []
        for k, text in enumerate(texts):
            if self.fast and (text.isascii() or max(text) < AFTER_LATIN):
                of_a[k] = self.fast(" " + text)
            else:
                slow.append(k)
        for k, found in zip(slow, self.a.encode_batch_fast([" " + texts[k] for k in slow], add_special_tokens=False)):
            of_a[k] = found.ids
        return of_a

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a blank and each text by A, and of the text by B, which puts a blank before it."""
        return self.encode_a(texts), self.b.encode(texts, num_threads=1)

    def encode_parts(self, parts: list[str], sizes: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts by A in a row and how many each has, and the same of B; ``sizes`` are bytes with the blank.

        ``plain`` ones go to the faster library as one text with seams between them.
        """
        even, single = np.flatnonzero(plain & bool(self.fast)), np.flatnonzero(~plain | (not self.fast))
        at_once = parts if not len(single) else [parts[k] for k in even.tolist()]
        a, _ = flattened([self.fast(" " + " ".join(at_once[at : at + JOINED])) for at in range(0, len(even), JOINED)])
        bounds, reached = ends(sizes[even])[1:], np.cumsum(self.lengths_a[a])
        upto = np.searchsorted(reached, bounds)
        if len(even) and (reached[-1] != bounds[-1] or (reached[upto] != bounds).any()):
            return self.encode_parts(parts, sizes, np.zeros(len(parts), bool))
        n_a = np.diff(upto + 1, prepend=0)
        if len(single):
            rest, n_rest = flattened(self.encode_a([parts[k] for k in single.tolist()]))
            a, n_a = ordered(np.concatenate([a, rest]), np.concatenate([n_a, n_rest]), np.concatenate([even, single]), len(parts))
        return a, n_a, *flattened(self.b.encode(parts, num_threads=1))

    def spell(self, text: str, a: list[int], b: list[int]) -> bool:
        data = b" " + text.encode()
        return b"".join([self.bytes_a[i] for i in a]) == data == b"".join([self.bytes_b[i] for i in b])

    def spelt(self, data: bytes, sizes: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether both sides spell a part, for each; ``data`` holds them all, a blank before each."""
        good, at = np.ones(len(sizes), bool), ends(sizes)
        for ids, n, table in ((a, n_a, self.spelling_a), (b, n_b, self.spelling_b)):
            spelling, bounds = concatenated(table, ids)
            of_part = bounds[ends(n)]
            if spelling != data or (of_part != at).any():
                good &= [spelling[s:e] == data[x:y] for s, e, x, y in zip(*(v.tolist() for v in (of_part[:-1], of_part[1:], at[:-1], at[1:])))]
        return good

    def separable(self) -> bool:
        """Whether tokens never span a seam."""
        inner = any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.b.get_piece_size()))
        apart = [tuple(sum(ids, []) for ids in self.encode(SEAM.split(p))) for p in PROBES]
        return not inner and list(zip(*self.encode(list(PROBES)))) == apart


class Transducer:
    """States are (side that leads, its unmatched bytes), numbered as they are met; 0 is none.

    Transitions are remembered as state and token in one number.
    """

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.bytes = (None, bytes_a, bytes_b)
        self.lengths = (None, *(np.array(list(map(len, x)), np.int64) for x in (bytes_a, bytes_b)))
        self.text_a, self.text_b = list(map(str, range(len(bytes_a)))), list(map(str, range(len(bytes_b))))
        #: Ids of A and then of B as text, each with what follows it inside and at the end of its side of a group.
        self.signs = pa.array([i + sign for ids, two in ((self.text_a, ",|"), (self.text_b, ",;")) for i in ids for sign in two], pa.large_string()).cast(pa.large_binary())
        self.forget()

    def forget(self) -> None:
        self.side, self.rest = [0], [b""]
        self.number: dict[tuple[int, bytes], int] = {}
        self.memo: dict[int, int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side that doesn't lead (of A, if none does)."""
        side, rest = self.side[state], self.rest[state]
        other = 2 if side == 1 else 1
        new = self.bytes[other][token]
        if not (new.startswith(rest) or rest.startswith(new)):
            raise ValueError("the two sides spell different bytes")
        left = (side, rest[len(new) :]) if len(new) < len(rest) else (other, new[len(rest) :])
        to = self.number.setdefault(left, len(self.side)) if left[1] else 0
        if to == len(self.side):
            self.side.append(left[0])
            self.rest.append(left[1])
        self.memo[state << 20 | token] = to
        return to

    def walk(self, a: list[int], b: list[int], links: list[int]) -> tuple[str, int]:
        """Groups as ``a1,a2|b1;a3|b2,b3`` and their number; linked ids (A << 32 | B) go to ``links``."""
        if len(self.memo) > TRANSITIONS:
            self.forget()
        known, side, text_a, text_b = self.memo.get, self.side, self.text_a, self.text_b
        groups = []
        i = j = y = 0
        while i < len(a):
            p, q, x = i, j, a[i]
            i += 1
            state = known(x)
            if state is None:
                state = self.step(0, x)
            while state:
                if side[state] == 1:
                    token = y = b[j]
                    j += 1
                else:
                    token = x = a[i]
                    i += 1
                links.append(x << 32 | y)
                to = known(state << 20 | token)
                state = self.step(state, token) if to is None else to
            one = text_a[x] if i - p == 1 else ",".join([text_a[t] for t in a[p:i]])
            two = text_b[y] if j - q == 1 else ",".join([text_b[t] for t in b[q:j]])
            groups.append(f"{one}|{two}")
        return ";".join(groups), len(groups)


    def walk_all(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """``walk`` of parts whose sides spell the same, a step of all of them at a time: groups with a last ``;``, their number, and all links.

        A part takes as many steps as it has tokens, so the longest come first and those that still walk are a slice.
        """
        steps = n_a + n_b
        order = np.argsort(-steps)
        first_a, first_b = ends(n_a), ends(n_b)
        i, j, at = first_a[order], first_b[order], (first_a + first_b)[order]
        long_a, long_b = self.lengths[1][a], self.lengths[2][b]
        close_a, close_b, links = np.zeros(len(a), bool), np.zeros(len(b), bool), np.zeros(len(a) + len(b), np.int64)
        dangling = np.zeros(len(order), np.int64)  # bytes of A's last token, or, negative, of B's
        walking = np.searchsorted(-steps[order], -np.arange(steps.max(initial=0)))
        for t, n in enumerate(walking.tolist()):
            left = dangling[:n]
            of_a = left <= 0
            i[:n] += of_a
            j[:n] += ~of_a
            x, y = i[:n] - 1, j[:n] - 1
            links[at[:n] + t] = np.where(left == 0, -1, a[x] << 32 | b[y])
            left += np.where(of_a, long_a[x], -long_b[y])
            closed = left == 0
            close_a[x[closed]] = True
            close_b[y[closed]] = True
        last_a, last_b = np.flatnonzero(close_a) + 1, np.flatnonzero(close_b) + 1
        text = np.zeros(len(a) + len(b), np.int64)
        text[np.arange(len(a)) + np.concatenate([[0], last_b])[np.cumsum(close_a) - close_a]] = 2 * a + close_a
        text[np.arange(len(b)) + last_a[np.cumsum(close_b) - close_b]] = 2 * (len(self.text_a) + b) + close_b
        data, bounds = concatenated(self.signs, text)
        cuts = bounds[first_a + first_b].tolist()
        return [data[s:e] for s, e in zip(cuts, cuts[1:])], np.diff(ends(close_a)[first_a]), links[links >= 0]


def parts_of(text: str, separable: bool) -> Iterator[list[str]]:
    """The parts between seams, in blocks of bounded size."""
    if not separable:
        yield [text]
        return
    at = 0
    while at < len(text):
        seam = SEAM.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        block = text[at : seam.start()] if seam else text[at:]
        yield SEAM.split(block) if UNEVEN.search(block) else block.split(" ")
        at += len(block) + 1


class Chunk:
    """Distinct parts met so far, each encoded and walked once."""

    def __init__(self, tokenizers: Tokenizers, transducer: Transducer, separable: bool):
        self.tokenizers, self.transducer, self.separable = tokenizers, transducer, separable
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.texts: list[bytes] = []  # groups, a ; after each
        self.sizes = np.zeros((0, 5), np.int64)  # spelt, tokens of A, of B, groups, links
        self.times = np.zeros(0, np.int64)
        self.links = [np.zeros(0, np.int64)]
        self.chars = 0

    def numbers(self, parts: list[list[str]]) -> np.ndarray:
        """The numbers of all parts in a row; new ones are learnt."""
        found = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        new = list(islice(self.number, len(self.texts), None))
        for at in range(0, len(new), AT_ONCE):
            self.learn(new[at : at + AT_ONCE])
        self.times = np.concatenate([self.times, np.zeros(len(new), np.int64)])
        return found

    def learn(self, some: list[str]) -> None:
        text = " " + " ".join(some)
        sizes, plain = measured(some, text)
        a, n_a, b, n_b = self.tokenizers.encode_parts(some, sizes, plain & self.separable)
        good = self.tokenizers.spelt(text.encode(), sizes, a, n_a, b, n_b)
        alone = n_a + n_b > STEPS
        few, many = np.flatnonzero(good & ~alone), np.flatnonzero(good & alone)
        here = np.repeat(good & ~alone, n_a), np.repeat(good & ~alone, n_b)
        found, n_groups, links = self.transducer.walk_all(a[here[0]], n_a[few], b[here[1]], n_b[few])
        texts, groups = [b""] * len(some), np.zeros(len(some), np.int64)
        groups[few] = n_groups
        for k, text in zip(few.tolist(), found):
            texts[k] = text
        first_a, first_b, more = ends(n_a), ends(n_b), []
        for k in many.tolist():
            text, groups[k] = self.transducer.walk(a[first_a[k] : first_a[k + 1]].tolist(), b[first_b[k] : first_b[k + 1]].tolist(), more)
            texts[k] = text.encode() + b";"
        n_links = n_a + n_b - groups  # every step but a group's first
        walked = np.concatenate([few, many])
        self.links.append(ordered(np.concatenate([links, np.array(more, np.int64)]), n_links[walked], walked, len(some))[0])
        self.texts += texts
        self.sizes = np.concatenate([self.sizes, np.stack([good.astype(np.int64), n_a, n_b, groups, n_links], 1) * good[:, None]])

    def full(self) -> bool:
        return len(self.texts) >= PARTS or self.chars >= CHARS


class Builder:
    """Rows of documents and chunks, see ``ROWS``."""

    def __init__(self, tokenizers: Tokenizers, task: int):
        self.tokenizers, self.transducer = tokenizers, Transducer(tokenizers.bytes_a, tokenizers.bytes_b)
        self.separable = tokenizers.separable()
        self.task, self.chunks = task, 0
        self.open()

    def open(self) -> None:
        self.chunk = Chunk(self.tokenizers, self.transducer, self.separable)
        self.id = self.task << 24 | self.chunks
        self.chunks += 1

    def summed(self, of: np.ndarray, items: np.ndarray, times: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
        """(tokens of A, of B, groups and links of each row, number of its parts, parts, times); rows ``of`` hold ``items``, all of them spelt or it has none."""
        sizes = self.chunk.sizes[items]
        held = np.bincount(of, sizes[:, 0] == 0, rows)[of] == 0
        of, items, times, sizes = of[held], items[held], times[held], sizes[held]
        np.add.at(self.chunk.times, items, times)
        bounds = np.searchsorted(of, np.arange(rows + 1))
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sizes[:, 1:] * times[:, None], 0)])[bounds]
        return np.diff(sums, axis=0), np.diff(bounds), items, times

    def short(self, texts: list[str | None], keep: bool) -> tuple:
        """``documents`` of texts without tokens or of a block at most; all their parts at once."""
        parts = [() if not t else SEAM.split(t) if UNEVEN.search(t) else t.split(" ") for t in texts]
        numbers = self.chunk.numbers(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        found, times = np.unique(np.repeat(np.arange(len(texts)), lengths) << 32 | numbers, return_counts=True)
        columns = self.summed(found >> 32, found & 0xFFFFFFFF, times, len(texts))
        text_of, numbers, at = self.chunk.texts.__getitem__, numbers.tolist(), ends(lengths).tolist()
        digests, kept = [], []
        for s, e, n in zip(at, at[1:], columns[1].tolist()):
            text = b"".join(map(text_of, numbers[s:e]))[:-1] if n else b""
            digests.append(hashlib.sha256(text).hexdigest() if n else "")
            if keep:
                kept.append(text.decode())
        return *columns, digests, kept

    def long(self, text: str, keep: bool) -> tuple:
        """``documents`` of one text, a block at a time."""
        digest, kept = hashlib.sha256(), []
        ids, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, parts in enumerate(parts_of(text, self.separable)):
            numbers = self.chunk.numbers([parts])
            groups = (b";" if k else b"") + b"".join(map(self.chunk.texts.__getitem__, numbers.tolist()))[:-1]
            digest.update(groups)
            if keep:
                kept.append(groups.decode())
            here, n = np.unique(numbers, return_counts=True)
            if k:
                here, back = np.unique(np.concatenate([ids, here]), return_inverse=True)
                n = np.bincount(back, np.concatenate([times, n])).astype(np.int64)
            ids, times = here, n
        columns = self.summed(np.zeros(len(ids), np.int64), ids, times, 1)
        good = len(columns[2]) > 0
        return *columns, [digest.hexdigest() if good else ""], ["".join(kept) if good else ""] if keep else []

    def documents(self, texts: list[str | None], keep: bool = False) -> tuple:
        """Of all texts: (n_a, n_b, n_groups and n_links; number of parts; parts and times in a row; groups_sha256; groups, if ``keep``)."""
        self.chunk.chars += sum(map(len, filter(None, texts)))
        runs = []
        for alone, some in groupby(texts, lambda t: bool(t) and not (self.separable and len(t) <= BLOCK)):
            runs += [self.long(t, keep) for t in some] if alone else [self.short(list(some), keep)]
        return *(np.concatenate(c) for c in list(zip(*runs))[:4]), *(list(chain.from_iterable(c)) for c in list(zip(*runs))[4:])

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(links of each part, their pairs' places, pairs, times) of the chunk; a new one is opened."""
        chunk = self.chunk
        lengths = chunk.sizes[:, 4]
        pairs, places = np.unique(np.concatenate(chunk.links), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, places, np.repeat(chunk.times, lengths))
        self.open()
        return lengths, places, pairs, counts


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Keys and texts of rows in blocks of bounded text; column 0 is the key, 1 the text."""
    for batch in batches:
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))]) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(bounds[:-1])) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            if end > at:
                yield batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at).to_pylist()


FIELDS = (("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("items", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("at", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()))
ROWS = "kind int, chunk long, key {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, items array<int>, times array<int>, at int, a int, b int, n long"


def batch_of(kind: int, chunk: int, rows: int, key: pa.Array, **columns) -> pa.RecordBatch:
    """Rows of ``ROWS``; columns that aren't given are null."""
    arrays = [pa.array([kind] * rows, pa.int32()), pa.array([chunk] * rows, pa.int64()), key]
    arrays += [c if isinstance(c := columns.get(name), pa.Array) else pa.nulls(rows, of) if c is None else pa.array(c, of) for name, of in FIELDS]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "chunk", "key", *(name for name, _ in FIELDS)])


def lists_of(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends(lengths).astype(np.int32)), pa.array(values.astype(np.int32)))


class Alignment:
    """Texts of a table aligned; ``rows`` is at rest, see ``ROWS``."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None):
        self.key = key
        self.kind = df.schema[key].dataType.simpleString()

        def staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import os

            from pyspark import TaskContext

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            task = TaskContext.get()
            builder, none = Builder(Tokenizers(path_a, path_b), task.partitionId() if task else 0), None

            def closed() -> Iterator[pa.RecordBatch]:
                chunk = builder.id
                lengths, places, pairs, counts = builder.close()
                yield batch_of(PARTS_OF_CHUNK, chunk, 1, pa.nulls(1, none), items=lists_of(places, [len(places)]), times=lists_of(lengths, [len(lengths)]))
                for at in range(0, len(pairs), 50_000):
                    some = pairs[at : at + 50_000]
                    yield batch_of(PAIR, chunk, len(some), pa.nulls(len(some), none), at=np.arange(at, at + len(some), dtype=np.int32), a=(some >> 32).astype(np.int32), b=(some & 0xFFFFFFFF).astype(np.int32), n=counts[at : at + len(some)])

            for keys, texts in blocks_of(batches):
                none = keys.type
                sums, lengths, items, times, digests, _ = builder.documents(texts)
                columns = {name: values for (name, _), values in zip(FIELDS, (*sums.T, digests))}
                yield batch_of(DOCUMENT, builder.id, len(texts), keys, **columns, items=lists_of(items, lengths), times=lists_of(times, lengths))
                if builder.chunk.full():
                    yield from closed()
            if none is not None:
                yield from closed()

        rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        self.rows = settle(rows.mapInArrow(staged, ROWS.format(key=self.kind)))

    def pairs(self) -> DataFrame:
        """(a, b, count) of every id pair linked anywhere."""
        return self.rows.where((F.col("kind") == PAIR) & (F.col("n") > 0)).groupBy("a", "b").agg(F.sum("n").alias("count"))

    def documents(self) -> DataFrame:
        """The columns of the ``op11`` digest for every row."""
        counts = settle(self.pairs())
        best = counts.groupBy("b").agg(F.max("count").alias("best"))  # an id of B meets each id of A once at most
        valued = counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("best")).cast("long").alias("top"))
        given = self.rows.where(F.col("kind") == PAIR).select(F.col("chunk").alias("of"), "at", "a", "b").join(valued, ["a", "b"]).select("of", "at", "count", "top")

        def summed(left: pa.Table, right: pa.Table) -> pa.Table:
            kinds = left.column("kind").to_numpy()
            docs = left.filter(pa.array(kinds == DOCUMENT)).combine_chunks()
            numbers = lambda table, name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            between = lambda values, bounds: ends(values)[bounds[1:]] - ends(values)[bounds[:-1]]
            chunk = left.filter(pa.array(kinds == PARTS_OF_CHUNK))
            places, lengths = numbers(chunk, "items"), numbers(chunk, "times")
            at = right.column("at").to_numpy()
            out = {name: docs.column(name) for name in ("key", "n_a", "n_b", "n_groups", "n_links")}
            items, times = numbers(docs, "items"), numbers(docs, "times")
            sizes = docs.column("items").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            for name, column in (("n_best", "top"), ("count_sum", "count")):
                of_pair = np.zeros(places.max(initial=-1) + 1, np.int64)
                of_pair[at] = right.column(column).to_numpy()
                out[name] = pa.array(between(between(of_pair[places], ends(lengths))[items] * times, ends(sizes)).astype(np.int64))
            return pa.table(out | {"groups_sha256": docs.column("groups_sha256")})

        schema = f"key {self.kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        held = self.rows.where(F.col("kind") != PAIR).select("kind", "chunk", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "items", "times")
        return held.groupBy("chunk").cogroup(given.groupBy("of")).applyInArrow(summed, schema).withColumnRenamed("key", self.key)


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """key and groups (``a1,a2|b1;a3|b2,b3``) of every row; null without tokens."""
    kind = df.schema[key].dataType.simpleString()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Builder(Tokenizers(path_a, path_b), 0)
        for keys, texts in blocks_of(batches):
            kept = builder.documents(texts, keep=True)[-1]
            yield pa.RecordBatch.from_arrays([keys, pa.array([k or None for k in kept], pa.string())], names=["key", "groups"])
            if builder.chunk.full():
                builder.open()

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(grouped, f"key {kind}, groups string").withColumnRenamed("key", key)


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The ``op11`` digest."""
    return Alignment(docs, path_a=path_a, path_b=path_b).documents()
