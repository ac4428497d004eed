"""SentencePiece BPE encoding by suffix-array matching, and decoding.

A text is normalised as the model says (a leading space, spaces as U+2581) and cut where no piece can reach across:
before a run of spaces and around characters that the model lacks, which become bytes.  The distinct chunks of a batch
that the worker doesn't know yet are joined to one text, over which a suffix array of the longest piece's depth is built
by rank doubling; the pieces stand behind the text and so have ranks of their own.  Every piece's occurrences are one
range of the array, found by binary search; the ranges give edges, which are sorted by position and relaxed from left to
right.

The model is a BPE, so an edge isn't scored but admitted: a row of pieces is the BPE's encoding exactly if each pair of
neighbours is one that the merges would not have crossed, and every prefix has one such row.  So relaxing keeps, for each
position, the one piece that ends there and fits the piece before it.  Results equal the library's.

A chunk falls apart further wherever no occurrence of a piece reaches across, as no merge can; the parts are relaxed side
by side, and one that stays long, such as one sign thousands of times over, by itself.  A chunk of more than MATCH_CHARS
characters is matched in windows.

Nulls: a null text, as an empty one, has no pieces and decodes to the empty text.  Repeated rows are encoded alike.  An
empty table stays empty.  Extra columns are kept; those of the names added are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sluice.llm import kernels as K
from sluice.llm import scratch

SPACE = 0x2581
#: Characters of texts whose new chunks are gathered, and of new chunks under one suffix array.
BATCH_CHARS, MATCH_CHARS = 1_500_000, 150_000
#: Characters from which a part is relaxed by itself.
LONG = 512


class Model:
    """A SentencePiece BPE model with byte fallback, prepared for matching."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        text = {i: sp.id_to_piece(i) for i in normal}
        # single characters come first, then pieces by falling score: the order of the merges
        order = sorted(normal, key=lambda i: (len(text[i]) > 1, -sp.get_score(i), i))
        self.pieces = [text[i] for i in order]
        self.ids = np.array(order, np.int64)
        self.lens = np.array([len(p) for p in self.pieces], np.int64)
        self.number = {p: k for k, p in enumerate(self.pieces)}
        self.n = len(order)
        self.bytes = np.zeros(256, np.int64)
        self.surface = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.bytes[value], self.surface[i] = i, bytes([value])
        for i, p in text.items():
            self.surface[i] = p.replace(chr(SPACE), " ").encode()
        self.surface[sp.unk_id()] = " ⁇ ".encode()
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.size = np.array([len(s) for s in self.surface], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.cuts = not any(chr(SPACE) in p.lstrip(chr(SPACE)) for p in self.pieces)
        self.char = np.zeros(0x110000, np.int32)
        for k, c in enumerate(sorted(p for p in self.pieces if len(p) == 1)):
            self.char[ord(c)] = k + 2  # 1 parts the chunks
        self._merges()
        codes = np.frombuffer("".join(self.pieces).encode("utf-32-le"), np.uint32)
        known = self.char[codes]
        whole = np.minimum.reduceat(known, np.cumsum(self.lens) - self.lens) > 0
        self.matched = np.flatnonzero(self.reached & whole)
        self.store = K.SegmentStore(np.uint16 if n <= 1 << 16 else np.uint32)

    def _merges(self) -> None:
        """Which pairs merge into what, and what each piece was last merged from."""
        number, keys, to = self.number, [], []
        self.left, self.right = np.arange(self.n), np.arange(self.n)
        self.reached = self.lens == 1
        for k, p in enumerate(self.pieces):
            if len(p) == 1:
                continue
            for c in range(1, len(p)):
                if (a := number.get(p[:c])) is not None and (b := number.get(p[c:])) is not None:
                    keys.append(a * self.n + b)
                    to.append(k)
            symbols = list(p)
            while len(symbols) > 2:
                ranks = [number.get(x + y, self.n) for x, y in zip(symbols, symbols[1:], strict=False)]
                low = min(ranks)
                if low == self.n:
                    break
                at = ranks.index(low)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if len(symbols) == 2 and all(s in number for s in symbols):
                self.left[k], self.right[k], self.reached[k] = number[symbols[0]], number[symbols[1]], True
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b may stand side by side: no merge of their parts would have crossed the border.

        Takes the pairs apart merge by merge, last merge first, with the number below which a crossing merge would have
        come earlier.
        """
        ok = np.zeros(len(a), bool)
        live, x, y = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), self.n)
        while len(live):
            key = x * self.n + y
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            over = (self.pair_keys[place] == key) & (self.pair_to[place] < limit)
            live, x, y, limit = live[~over], x[~over], y[~over], limit[~over]
            # the later merge is undone; a single character can't be
            later = x > y
            nx, ny = self.right[x], self.left[y]
            x_single, y_single = nx == x, ny == y
            first = (later & ~x_single) | (~later & y_single & ~x_single)
            second = ~first & ~y_single
            done = ~first & ~second
            ok[live[done]] = True
            limit = np.where(first, x, np.where(second, y + 1, limit))
            x, y = np.where(first, nx, x), np.where(second, ny, y)
            live, x, y, limit = live[~done], x[~done], y[~done], limit[~done]
        return ok

    def match(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of every occurrence of a piece in text (character numbers, 1 between chunks)."""
        lens = self.lens[self.matched]
        codes = np.frombuffer("\0".join(self.pieces[k] for k in self.matched.tolist()).encode("utf-32-le"), np.uint32)
        tail = self.char[codes]
        tail[codes == 0] = 1
        depth = int(lens.max())
        r = np.concatenate([text, np.ones(1, np.int32), tail, np.zeros(2 * depth, np.int32)])
        home = len(text) + 1 + np.cumsum(lens + 1) - lens - 1
        ranks, step = {1: r}, 1
        while step < depth:
            key = r.astype(np.int64)
            key *= int(r.max()) + 1
            key[:-step] += r[step:]
            r = np.unique(key, return_inverse=True)[1].astype(np.int32)
            step *= 2
            ranks[step] = r
        array = np.argsort(r, kind="stable").astype(np.int32)
        array = array[array < len(text)]
        found_at, found = [], []
        for n in np.unique(lens).tolist():
            p = 1 << (n.bit_length() - 1)
            rank = ranks[p]
            wide = int(rank.max()) + 1
            mine = np.flatnonzero(lens == n)
            keys = rank[home[mine]].astype(np.int64) * wide + rank[home[mine] + n - p]
            at = rank[array].astype(np.int64) * wide + rank[array + n - p]
            low, high = np.searchsorted(at, keys, "left"), np.searchsorted(at, keys, "right")
            found_at.append(array[K.gather_ranges(low, high - low)])
            found.append(np.repeat(self.matched[mine].astype(np.int32), high - low))
        return np.concatenate(found_at), np.concatenate(found)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids and the number of ids of each chunk; a chunk is one unknown character or all known ones."""
        if len(chunks) == 1 and len(chunks[0]) > MATCH_CHARS:
            ids = self._encode_long(chunks[0])
            return ids, np.array([len(ids)])
        codes = np.frombuffer("\0".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = self.char[codes]
        text[codes == 0] = 1
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start = np.cumsum(sizes + 1) - sizes - 1
        position, piece = self.match(text)
        last = self._relax(position, piece, start, len(text))
        # back from each chunk's end
        out: list[tuple[np.ndarray, np.ndarray]] = []
        known = text[start] > 1
        chunk, at = np.flatnonzero(known), (start + sizes)[known]
        while len(chunk):
            if len(chunk) == 1:
                p = self._back(last, int(start[chunk[0]]), int(at[0]))
                out.append((np.full(len(p), chunk[0]), p))
                break
            p = last[at]
            out.append((chunk, p))
            at = at - self.lens[p]
            more = at > start[chunk]
            chunk, at = chunk[more], at[more]
        owner = np.concatenate([c for c, _ in out][::-1]) if out else np.zeros(0, np.int64)
        ids = self.ids[np.concatenate([p for _, p in out][::-1])] if out else np.zeros(0, np.int64)
        for k in np.flatnonzero(~known).tolist():
            raw = np.frombuffer(chunks[k].encode("utf-8", "surrogatepass"), np.uint8)
            owner, ids = np.concatenate([owner, np.full(len(raw), k)]), np.concatenate([ids, self.bytes[raw]])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(chunks))

    def _back(self, last: np.ndarray, start: int, at: int) -> np.ndarray:
        """The pieces from start to at."""
        out, piece, lens = [], last[start : at + 1].tolist(), self.lens.tolist()
        while at > start:
            out.append(piece[at - start])
            at -= lens[out[-1]]
        return np.array(out[::-1], np.int64)

    def _free(self, position: np.ndarray, piece: np.ndarray, n: int) -> np.ndarray:
        """For each of n + 1 places whether no occurrence of a piece reaches across."""
        lens = self.lens[piece]
        wide = lens > 1
        over = np.bincount(position[wide] + 1, minlength=n + 2) - np.bincount(position[wide] + lens[wide], minlength=n + 2)
        return np.cumsum(over)[: n + 1] == 0

    def _relax(self, position: np.ndarray, piece: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """For each place of n characters the piece that ends there, -1 for none; chunks begin at start."""
        last = np.full(n + 2, -1, np.int64)
        first = np.zeros(n + 2, bool)
        first[:n] = self._free(position, piece, n)[:n]
        first[start] = True
        begin = np.flatnonzero(first)
        part = np.searchsorted(begin, position, "right") - 1
        long = np.diff(np.append(begin, n))[part] > LONG
        for k in np.unique(part[long]).tolist():
            mine = np.flatnonzero(part == k)
            self._relax_long(position[mine], piece[mine], int(begin[k]), last)
        position, piece, part = position[~long], piece[~long], part[~long]
        within = position - begin[part]
        order = np.argsort(within, kind="stable")
        position, piece, within = position[order], piece[order], within[order]
        for a, b in zip(*_stretches(within), strict=True):
            at, p = position[a:b], piece[a:b]
            before = last[at]
            ok = first[at]
            live = np.flatnonzero((before >= 0) & ~ok)
            ok[live] = self.fits(before[live], p[live])
            last[at[ok] + self.lens[p[ok]]] = p[ok]
        return last

    def _relax_long(self, position: np.ndarray, piece: np.ndarray, begin: int, last: np.ndarray) -> None:
        """Relaxes one part from left to right; pairs of pieces recur, so what fits is looked up."""
        order = np.argsort(position, kind="stable")
        ends = {0: -1}
        known: dict[tuple[int, int], bool] = {}
        lens = self.lens.tolist()
        for at, p in zip((position[order] - begin).tolist(), piece[order].tolist(), strict=True):
            before = ends.get(at)
            if before is None:
                continue
            if before >= 0:
                fit = known.get((before, p))
                if fit is None:
                    if len(known) > 1_000_000:
                        known.clear()
                    fit = known[before, p] = bool(self.fits(np.array([before]), np.array([p]))[0])
                if not fit:
                    continue
            ends[at + lens[p]] = p
        del ends[0]
        last[np.fromiter(ends, np.int64, len(ends)) + begin] = np.fromiter(ends.values(), np.int64, len(ends))

    def _encode_long(self, chunk: str) -> np.ndarray:
        """The ids of a very long chunk, window by window; a window ends where no piece reaches across."""
        out, a, width, most = [], 0, MATCH_CHARS, int(self.lens.max())
        while a < len(chunk):
            text = self.char[np.frombuffer(chunk[a : a + width].encode("utf-32-le", "surrogatepass"), np.uint32)]
            position, piece = self.match(text)
            cut = len(text)
            if a + width < len(chunk):
                free = np.flatnonzero(self._free(position, piece, cut)[1 : max(1, cut - most)]) + 1
                if not len(free):
                    width *= 2
                    continue
                cut = int(free[-1])
            inside = position < cut
            last = self._relax(position[inside], piece[inside], np.zeros(1, np.int64), cut)
            out.append(self.ids[self._back(last, 0, cut)])
            a, width = a + cut, MATCH_CHARS
        return np.concatenate(out)

    def _cut(self, texts: list[str | None]):
        joined = "".join(f" {t}" for t in texts if t).replace(" ", chr(SPACE))
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts)))])
        start = np.zeros(len(codes) + 1, bool)
        start[bounds] = True
        unknown = self.char[codes] == 0
        start[:-1] |= unknown
        start[1:] |= unknown
        if self.cuts:
            space = codes == SPACE
            start[1:-1] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(start[:-1])
        ends = np.append(starts[1:], len(codes)) if len(starts) else starts
        return joined, codes, bounds, starts, ends

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for a, b in K.slices(texts, BATCH_CHARS):
            yield from self._encode(texts[a:b])

    def _encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        self.store.trim()
        parts, new = [], {}
        for a, b in K.slices(texts):
            joined, codes, bounds, starts, ends = self._cut(texts[a:b])
            classes, hashes, first = K.distinct(K.segment_hashes(codes, starts, ends))
            lacking = np.flatnonzero(self.store.find(hashes) < 0)
            for h, f in zip(hashes[lacking].tolist(), first[lacking].tolist(), strict=True):
                if h not in new:
                    new[h] = joined[starts[f] : ends[f]]
            parts.append((classes, hashes, np.searchsorted(starts, bounds)))
        keys, chunks = list(new), list(new.values())
        for a, b in K.slices(chunks, MATCH_CHARS):
            flat, lens = self.encode_chunks(chunks[a:b])
            self.store.add(np.array(keys[a:b], np.uint64), flat, lens)
        for classes, hashes, at in parts:
            where = self.store.find(hashes)[classes]
            lens = self.store.size[where]
            flat = self.store.flat[K.gather_ranges(self.store.start[where], lens)]
            ends = np.concatenate([[0], np.cumsum(lens)])[at]
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield flat[i:j]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the leading space that encoding added."""
        ids = ids.astype(np.int64)
        raw = self.flat[K.gather_ranges(self.at[ids], self.size[ids])].tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _stretches(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Bounds of the stretches of equal values."""
    if not len(values):
        return [], []
    cuts = np.flatnonzero(np.diff(values)) + 1
    return [0, *cuts.tolist()], [*cuts.tolist(), len(values)]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The worker's model; its memo of chunks outlives a task."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


ADDED = {"n_pieces": "long", "ids_crc32": "long", "decoded_sha256": "string", "lossless": "boolean"}


def encoded(docs: DataFrame, path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """docs with each text's pieces counted, their ids' CRC-32 (little-endian unsigned 32-bit), the decoded text's SHA-256
    and whether it equals the text; with ``ids``, the ids too.  Columns of such names are replaced."""
    added = ADDED | ({"ids": "array<int>"} if ids else {})
    docs = docs.drop(*added)
    names = docs.columns

    def run(batches):
        m = model(path)
        for b in batches:
            texts = b.column(names.index(text)).to_pylist()
            n, crc, sha, same, all_ids = [], [], [], [], []
            for t, x in zip(texts, m.encode(texts), strict=True):
                back = m.decode(x)
                n.append(len(x))
                crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == (t or ""))
                if ids:
                    all_ids.append(x.astype(np.int32))
            cols = [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
            cols += [pa.array(all_ids, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*names, *added])

    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{k} {v}" for k, v in added.items()])
    return scratch.map_arrow(docs, run, kind)


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", *ADDED)
