"""BPE encoding and decoding with word ends, in batched numpy merge rounds.

The pieces of a text come from the vocabulary file's own normaliser and
pattern.  Pieces not met before are encoded together: the symbols of all of
them lie in one flat array, pairs of neighbours are looked up by binary search
over the sorted keys of all merges, and each round merges in every piece the
pair of lowest rank, until no piece has a pair that merges.  Finished pieces
are remembered, so that frequent words cost one look-up.  A piece of over
``LONG`` bytes has many rounds; in it only pairs beside a merge are looked up
again, and places wait by rank, so its cost grows with its length alone.

Edge cases: a null or empty text has no ids and decodes to the empty text.
Special tokens written out in a text are encoded as such.  Any length of text
or word works.  Rows that repeat an id get a row each; an empty table gives an
empty result.  Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .token_counts import vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: Pieces that a task remembers, and texts' characters that are encoded together.
REMEMBERED, TOGETHER = 1 << 20, 1 << 21
LONG = 1024
#: Letters below U+0250 have no marks to compose: normalising is lower case alone.
_PLAIN = regex.compile("[\u0000-ɏ]*").fullmatch



def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if it prints in Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in shown)
    names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class WordBPE:
    """A vocabulary with its merges in arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in (vocab | self.special).items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.end] for s in symbols], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([(a << 32) | b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.key_of = keys[order], order, keys
        self.merged = np.array([c for _, _, c in pairs], np.int64)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern, regex.VERSION0)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.bytes_of = {s: b for b, s in enumerate(symbols)}
        self.slot: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat_tokens = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes

    def pieces(self, text: str) -> list:
        """The text's pieces; a special token is its id."""
        if self.specials is not None and "<|" in text and self.specials.search(text):
            out: list = []
            for part in self.specials.split(text):
                out.extend([self.special[part]] if part in self.special else self.pieces(part))
            return out
        if _PLAIN(text):
            return self.pattern.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        split = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self.bytes_of.__getitem__, p)).decode() for p, _ in split]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and how many each piece has."""
        raw = [p.encode() for p in pieces]
        long = {k: self.encode_long(np.frombuffer(r, np.uint8)) for k, r in enumerate(raw) if len(r) > LONG}
        raw = [b"" if k in long else r for k, r in enumerate(raw)]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(raw)), sizes)
        symbol = self.inner[data]
        ends = (np.cumsum(sizes) - 1)[sizes > 0]
        symbol[ends] = self.last[data[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.merged)
        while len(symbol):
            rank = np.full(len(symbol), none, np.int64)  # of the pair that begins here
            key = (symbol[:-1] << 32) | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(symbol))))
            over = (best == none)[run]
            if over.any():
                done.append((owner[over], symbol[over]))
                keep = ~over
                owner, symbol, rank, run = owner[keep], symbol[keep], rank[keep], run[keep]
                if not len(symbol):
                    break
            here = rank == best[run]
            # Of pairs that overlap, as in aaa, every second one merges.
            place = np.flatnonzero(here)
            fresh = np.append(True, np.diff(place) > 1)
            start = place[fresh][np.cumsum(fresh) - 1]
            place = place[(place - start) % 2 == 0]
            symbol[place] = self.merged[rank[place]]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            owner, symbol = owner[keep], symbol[keep]
        done += [(np.full(len(x), k), x) for k, x in long.items()]
        owner = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        symbol = np.concatenate([d[1] for d in done]) if done else owner
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.bincount(owner, minlength=len(raw)).astype(np.int64)

    def encode_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long piece."""
        n, symbol = len(data), self.inner[data]
        symbol[-1:] = self.last[data[-1:]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        there, waiting, ranks = np.ones(n, bool), defaultdict(list), []

        def wait(left: np.ndarray) -> None:
            key = (symbol[left] << 32) | symbol[after[left]]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank, left = self.ranks[at[hit]], left[hit]
            order = np.argsort(rank, kind="stable")
            rank, left = rank[order], left[order]
            first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])[: len(rank)])
            for r, places in zip(rank[first].tolist(), np.split(left, first[1:]), strict=False):
                if r not in waiting:
                    heappush(ranks, r)
                waiting[r].append(places)

        wait(np.arange(n - 1))
        while ranks:
            rank = heappop(ranks)
            place = np.unique(np.concatenate(waiting.pop(rank)))
            place = place[there[place]]
            place = place[after[place] < n]
            place = place[((symbol[place] << 32) | symbol[after[place]]) == self.key_of[rank]]
            if not len(place):
                continue
            fresh = np.append(True, after[place[:-1]] != place[1:])
            at = np.arange(len(place))
            place = place[(at - at[fresh][np.cumsum(fresh) - 1]) % 2 == 0]  # of pairs that overlap every second one merges
            symbol[place] = self.merged[rank]
            gone = after[place]
            there[gone] = False
            after[place] = after[gone]
            inside = after[place] < n
            before[after[place][inside]] = place[inside]
            left = before[place]
            wait(np.unique(np.concatenate([place[inside], left[left >= 0]])))
        return symbol[there]

    def remember(self, units: list[str]) -> None:
        """Encodes units, none of which is known, and keeps their ids."""
        split = [self.pieces(u) for u in units]
        names = {p: k for k, p in enumerate(dict.fromkeys(p for s in split for p in s if isinstance(p, str)))}
        special = {p: len(names) + k for k, p in enumerate(dict.fromkeys(p for s in split for p in s if isinstance(p, int)))}
        ids, sizes = self.encode_pieces(list(names))
        ids = np.concatenate([ids, np.array(list(special), np.int64)])
        sizes = np.concatenate([sizes, np.ones(len(special), np.int64)])
        starts = np.cumsum(sizes) - sizes
        slots = np.array([names[p] if isinstance(p, str) else special[p] for s in split for p in s], np.int64)
        ids, ends = gather(ids, starts[slots], sizes[slots])
        ends = np.concatenate([[0], ends])[np.cumsum([len(s) for s in split])]
        starts = np.concatenate([[0], ends[:-1]])
        self.slot.update(zip(units, range(len(self.sizes), len(self.sizes) + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + starts])
        self.sizes = np.concatenate([self.sizes, ends - starts])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the n+1 offsets of the texts.

        No piece crosses a blank, so texts are looked up by what stands between blanks.
        """
        split = [t.split(" ") if t else [] for t in texts]
        flat = [u for s in split for u in s]
        if len(self.slot) > REMEMBERED:
            self.slot.clear()
            self.ids, self.starts, self.sizes = self.ids[:0], self.starts[:0], self.sizes[:0]
        if new := [u for u in dict.fromkeys(flat) if u not in self.slot]:
            self.remember(new)
        slots = np.fromiter(map(self.slot.__getitem__, flat), np.int64, len(flat))
        ids, ends = gather(self.ids, self.starts[slots], self.sizes[slots])
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in split], dtype=np.int64)])
        return ids, np.concatenate([[0], ends])[bounds]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids: the file has no decoder, so tokens stand as they are, a blank between two."""
        sizes = self.token_sizes[ids] + 1
        shown, ends = gather(self.flat_tokens, self.token_starts[ids], self.token_sizes[ids])
        out = np.full(int(sizes.sum()), 32, np.uint8)
        if len(ids):
            out[np.arange(len(shown)) + np.repeat(np.arange(len(ids)), self.token_sizes[ids])] = shown
        cuts = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        return [out[a : max(a, b - 1)].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All runs values[start:start + size] one behind the other, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)], ends


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_ids adds ids (array<int>) and decoded (string)."""
    prepare(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordBPE(path or vocabulary_path(VOCABULARY))
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
            first = 0
            while first < batch.num_rows:
                before = int(sizes[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, before + TOGETHER, "right")))
                ids, offsets = code.encode(batch.column(1).slice(first, last - first).to_pylist())
                narrow = ids.astype("<u4")
                decoded = code.decode(ids, offsets)
                columns = [batch.column(0).slice(first, last - first), pa.array(np.diff(offsets)),
                           pa.array([hashlib.sha256(narrow[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]),
                           pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32)), pa.array([d.decode() for d in decoded])]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])
                first = last

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
