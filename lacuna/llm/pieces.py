"""Sampled SentencePiece segmentations by forward filtering, backward sampling.

The pieces of a model span a lattice over a text.  A path's probability is the
product of its pieces' weights; the forward pass sums the weights of all paths
to each node, the backward pass draws one path from the end, choosing each edge
in proportion to (forward sum at its start) x (its weight).  That is an exact
draw from all segmentations, not one of an n-best list.

Weights: the public model is a BPE model whose scores are merge ranks, not log
probabilities, so a piece of rank r weighs (r + 3) ** -``alpha`` (Zipf's law).
Characters without a piece of their own are spelled in byte pieces.

The uniform number of a choice is a hash of (seed, row key, position in the
text), so a row's segmentation depends on nothing else: neither partitions nor
batches nor retries change it.

No piece goes on past the start of a word, so the lattice falls apart at word
starts: forward sums are computed once per distinct word of a block (numpy, all
words at once, position by position) and only the backward draw runs for each
occurrence (numpy, all occurrences at once).  Should a model have pieces across
word starts, texts are taken as one word each.

Decoding is lossless for every text: blanks are written as U+2581 and a U+2581
of the text itself is spelled in bytes.

Defined cases: a null text gives null pieces, counted 0; an empty text none; a
text of any length is cut at word starts into parts of bounded size; rows map one
to one, so repeated rows, null keys (hashed as ``null``) and empty tables need
nothing; other columns, whatever their names, never enter the plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

VOCABULARY = "piece_bpe_32k.model"
ALPHA = 1.0
SEED = 1
BLOCK = 1 << 21
MARK = "▁"
#: Stands for a U+2581 of the text; no valid text holds a lone surrogate.
RAW_MARK = "\ud800"
CP_BITS = 21
STRIDE = 1 << 14
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_model(path: str) -> dict:
    """Pieces, byte pieces and scores of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[int, str] = {}
    byte_ids = np.full(256, -1, np.int32)
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[i] = sp.id_to_piece(i)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so it can't spell every text")
    scores = np.array([sp.get_score(i) for i in range(sp.get_piece_size())])
    return {"pieces": pieces, "byte_ids": byte_ids, "scores": scores, "size": sp.get_piece_size()}


class Segmenter:
    """Trie and weights of a model as arrays; made on the driver, bounded by the vocabulary."""

    def __init__(self, model: dict, alpha: float = ALPHA):
        self.byte_ids = model["byte_ids"]
        self.weight = -alpha * np.log(3.0 - np.maximum(model["scores"], -1e12))
        self.byte_weight = -alpha * float(np.log(model["size"]))
        child: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        self.across = False
        for i, piece in model["pieces"].items():
            self.across |= MARK in piece.lstrip(MARK)
            node = 0
            for c in map(ord, piece):
                if (node, c) not in child:
                    child[node, c] = len(piece_at)
                    piece_at.append(-1)
                node = child[node, c]
            piece_at[node] = i
        keys = np.array([n << CP_BITS | c for n, c in child], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.fromiter(child.values(), np.int32)[order]
        self.root = np.full(1 << 16, -1, np.int32)  # the first step is a table look-up
        for (node, c), to in child.items():
            if node == 0 and c < 1 << 16:
                self.root[c] = to
        self.piece_at = np.array(piece_at, np.int32)
        self.text_of = {i: p.replace(MARK, " ") for i, p in model["pieces"].items()} | {int(i): chr(b) if b < 128 else bytes([b]) for b, i in enumerate(self.byte_ids)}

    @classmethod
    def of(cls, parts: dict) -> Segmenter:
        """A segmenter of the attributes of another."""
        own = cls.__new__(cls)
        own.__dict__.update(parts)
        return own

    def edges(self, cps: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in the words: start, length, piece (-1: spelled in bytes), by length."""
        starts, lengths, ids = [], [], []
        at = np.arange(len(cps), dtype=np.int32)
        low = np.minimum(cps, (1 << 16) - 1)
        node = np.where(cps < 1 << 16, self.root[low], -1)
        far = np.flatnonzero(cps >= 1 << 16)
        if len(far):
            j = np.minimum(np.searchsorted(self.keys, cps[far].astype(np.int64)), len(self.keys) - 1)
            node[far] = np.where(self.keys[j] == cps[far], self.child[j], -1)
        single = np.zeros(len(cps), bool)
        at, node, k = at[node >= 0], node[node >= 0], 1
        while len(at):
            piece = self.piece_at[node]
            has = piece >= 0
            starts.append(at[has])
            lengths.append(np.full(int(has.sum()), k, np.int32))
            ids.append(piece[has])
            if k == 1:
                single[at[has]] = True
            on = rest[at] > k
            at, node = at[on], node[on]
            key = node.astype(np.int64) << CP_BITS | cps[at + k]
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[j] == key
            at, node, k = at[hit], self.child[j[hit]], k + 1
        spelled = np.flatnonzero(~single).astype(np.int32)
        starts.append(spelled)
        lengths.append(np.ones(len(spelled), np.int32))
        ids.append(np.full(len(spelled), -1, np.int32))
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)

    def filtered(self, words: list[str]) -> dict:
        """Forward pass over distinct words: edges by end node, with cumulated chances."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        cps = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        word = np.repeat(np.arange(len(words)), n)
        rest = first[1:][word] - np.arange(len(cps))
        start, length, piece = self.edges(cps, rest)
        n_bytes = np.where(cps == ord(RAW_MARK), 3, 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000))
        weight = np.where(piece >= 0, self.weight[piece], self.byte_weight * n_bytes[start])
        tail = start + word[start]  # a word of n characters has n + 1 nodes
        head = tail + length
        order = np.argsort(head, kind="stable")  # equal heads stay by length
        tail, head, piece, weight = tail[order], head[order], piece[order], weight[order]
        nodes = len(cps) + len(words)
        degree = np.bincount(head, minlength=nodes)
        at = np.concatenate([[0], np.cumsum(degree)])  # first edge of a node
        base = first[:-1] + np.arange(len(words))
        depth = np.arange(nodes) - np.repeat(base, n + 1)
        forward = np.zeros(nodes)
        by_depth = np.argsort(depth, kind="stable")
        by_depth = by_depth[np.searchsorted(depth[by_depth], 1) :]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth[by_depth])) + 1, [len(by_depth)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = by_depth[a:b]
            d = degree[here]
            seg = np.concatenate([[0], np.cumsum(d)[:-1]])
            edge = np.arange(int(d.sum())) - np.repeat(seg, d) + np.repeat(at[here], d)
            forward[here] = np.logaddexp.reduceat(forward[tail[edge]] + weight[edge], seg)
        chance = np.exp(forward[tail] + weight - forward[head])
        kth = np.arange(len(head)) - at[head]
        for k in range(1, int(degree.max(initial=1))):
            e = np.flatnonzero(kth == k)
            chance[e] += chance[e - 1]
        chance[at[1:][degree > 0] - 1] = 2.0
        return {"end": base + n, "n": n, "at": at, "tail": tail, "piece": piece, "cum": chance, "depth": depth}

    def sample_block(self, parts: list[tuple[np.uint64, int, str]]) -> list[np.ndarray]:
        """Pieces of parts (row hash, offset of the part in its text, marked text)."""
        seen: dict[str, int] = {}
        which: list[int] = []
        counts = []
        for _, _, text in parts:
            words = [text] if self.across else WORDS.findall(text)
            which += [seen.setdefault(w, len(seen)) for w in words]
            counts.append(len(words))
        if not which:
            return [np.empty(0, np.int32) for _ in parts]
        lattice = self.filtered(list(seen))
        occ = np.array(which)
        lens = lattice["n"][occ]
        ends = np.cumsum(lens)  # of occurrences, in characters of the block
        per_part = np.repeat(np.arange(len(parts)), counts)
        sizes = np.fromiter((len(p[2]) for p in parts), np.int64, len(parts))
        part_start = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.fromiter((p[1] for p in parts), np.int64, len(parts)) - part_start[:-1]
        seeds = np.fromiter((p[0] for p in parts), np.uint64, len(parts))
        chosen = np.full(int(part_start[-1]), -2, np.int32)
        last = lattice["end"][occ]
        bases = ends - last  # position in the block = node + base
        streams = seeds[per_part] + (bases + shift[per_part]).astype(np.uint64) * GOLDEN
        at, cum, tail, piece, more = lattice["at"], lattice["cum"], lattice["tail"], lattice["piece"], lattice["depth"] > 0
        for a in range(0, len(occ), STRIDE):  # as many at once as stay in the cache
            node, base, stream = last[a : a + STRIDE], bases[a : a + STRIDE], streams[a : a + STRIDE]
            while len(node):
                u = uniform(stream + node.astype(np.uint64) * GOLDEN)
                edge = at[node]
                go = np.flatnonzero(u >= cum[edge])
                while len(go):  # the last edge of a node has a sum of 2, so this ends there
                    edge[go] += 1
                    go = go[u[go] >= cum[edge[go]]]
                chosen[node + base - 1] = piece[edge]
                node = tail[edge]
                on = np.flatnonzero(more[node])
                node, base, stream = node[on], base[on], stream[on]
        marked = np.flatnonzero(chosen > -2)
        ids = chosen[marked]
        bounds = np.searchsorted(marked, part_start)
        spelled: dict[int, list[tuple[int, list[int]]]] = {}
        unknown = np.flatnonzero(ids == -1)
        of_part = np.searchsorted(part_start, marked[unknown], side="right") - 1
        for k, i, c in zip(unknown.tolist(), of_part.tolist(), (marked[unknown] - part_start[of_part]).tolist()):
            char = parts[i][2][c]
            if char < "\x80":
                ids[k] = self.byte_ids[ord(char)]
            else:
                spelled.setdefault(i, []).append((k - int(bounds[i]), self.byte_ids[list(char.replace(RAW_MARK, MARK).encode())].tolist()))
        out = np.split(ids, bounds[1:-1])
        for i, those in spelled.items():
            longer, done = [], 0
            for k, more_ids in those:
                longer += [out[i][done:k], more_ids]
                done = k + 1
            out[i] = np.concatenate([*longer, out[i][done:]]).astype(np.int32)
        return out

    def sample(self, rows: list[tuple[int, str | None]], seed: int) -> list[np.ndarray | None]:
        """Pieces of rows (hash of the key, text)."""
        out: list[list[np.ndarray] | None] = []
        block: list[tuple[np.uint64, int, str]] = []
        owner: list[int] = []
        size = 0

        def flush():
            for i, ids in zip(owner, self.sample_block(block)):
                out[i].append(ids)
            block.clear()
            owner.clear()

        for key, text in rows:
            out.append(None if text is None else [])
            if not text:
                continue
            start = uniform_seed(key, seed)
            for offset, part in marked_parts(text, self.across):
                block.append((start, offset, part))
                owner.append(len(out) - 1)
                size += len(part)
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        return [None if x is None else np.concatenate(x) if x else np.empty(0, np.int32) for x in out]

    def decode(self, ids: list[int]) -> str:
        """The text of pieces; the blank put before every text is taken off again."""
        text_of = self.text_of
        got = [text_of[i] for i in ids]
        try:
            whole = "".join(got)
        except TypeError:  # byte pieces among them
            whole = b"".join(x if isinstance(x, bytes) else x.encode() for x in got).decode("utf-8", "replace")
        return whole[1:]


WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
WORD_START = re.compile(f"(?<=[^{MARK}]){MARK}")


def marked_parts(text: str, whole: bool) -> Iterator[tuple[int, str]]:
    """The text with its blanks marked and one put before it, cut at word starts."""
    marked = MARK + text.replace(MARK, RAW_MARK).replace(" ", MARK)
    at = 0
    while at < len(marked):
        cut = WORD_START.search(marked, at + BLOCK) if len(marked) - at > BLOCK and not whole else None
        end = cut.start() if cut else len(marked)
        yield at, marked[at:end]
        at = end


def uniform_seed(key: int, seed: int) -> np.uint64:
    return np.uint64((key ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF)


def uniform(z: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) of counters, by a 64-bit finaliser; overwrites them."""
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """key, pieces array<int> and lossless of every row of ``df``.

    ``path`` is the model file on the driver; ``lossless`` tells whether the
    pieces decode to exactly the text (null texts: true).
    """
    spark = df.sparkSession
    segmenter = spark.sparkContext.broadcast(vars(Segmenter(read_model(path or default_path()), alpha)))  # arrays only: workers need not have this package
    kind = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Segmenter.of(segmenter.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(2).to_pylist()
                ids = own.sample(list(zip(part.column(1).to_pylist(), texts)), seed)
                same = [t is None or own.decode(i.tolist()) == t if t else True for t, i in zip(texts, ids)]
                offsets = np.concatenate([[0], np.cumsum([0 if i is None else len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int32), *(i for i in ids if i is not None)])
                nulls = pa.array([i is None for i in ids], pa.bool_())
                pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=nulls)
                yield pa.RecordBatch.from_arrays([part.column(0), pieces, pa.array(same, pa.bool_())], names=["key", "pieces", "lossless"])

    rows = df.select(F.col(key).alias("key"), F.xxhash64(id_text(F.col(key))).alias("hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"key {kind}, pieces array<int>, lossless boolean").withColumnRenamed("key", key)


def decode_pieces(df: DataFrame, pieces: str = "pieces", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of the pieces (null for null)."""
    segmenter = df.sparkSession.sparkContext.broadcast(vars(Segmenter(read_model(path or default_path()))))

    @F.pandas_udf("string")
    def decoded(ids):
        own = Segmenter.of(segmenter.value)
        return ids.map(lambda x: None if x is None else own.decode(list(x)))

    return df.withColumn("decoded", decoded(F.col(pieces)))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The ``op10`` result: sampled pieces of every document."""
    return sample_pieces(docs, path=path).withColumn("n_pieces", F.when(F.col("pieces").isNull(), 0).otherwise(F.size("pieces")))
