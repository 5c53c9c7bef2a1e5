"""Best-fit packing of token sequences with swap-based local search.

Documents become token counts and checksums in one pass; ids themselves are not kept.  Pieces are
dealt evenly to blocks of bounded size, and each block is packed on its own: best-fit decreasing
over a table of free space, then exchanges between underfull bins that raise the sum of squared
fills (move one piece, swap one for one, two for one, one for two) until the emptiest bins are
empty or no exchange helps.  A block whose bins already meet the lower bound is left alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .common import per_text, text_bytes

WIDTH = 2048
BLOCK = 32768
DONORS = 8
CACHE, LONGEST = 250_000, 32
CLOSING = b".,!?;:"
# Letters up to here stay in one piece; a word that does not is noticed by the count of closing ids.
LATIN_END = "\u0250"


class WordTokens:
    """Ids of white-space separated words as packed bytes, remembered up to ``CACHE`` words of ``LONGEST`` bytes.

    The tokenizer drops white space, never joins across it and lower-cases, so words can be encoded
    apart and in lower case.  A word's closing punctuation is a piece of its own if a letter stands
    before it.  Plain Latin words are encoded together, without normalising what is lower-case and
    composed already: each is one piece, whose last id closes a word.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        # The same model, read once.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(1 + max(vocabulary.values()), dtype=bool)
        self.closes[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, words: list[bytes]) -> dict[bytes, bytes]:
        done = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {word: np.array(found.ids, dtype="<u4").tobytes() for word, found in zip(words, done, strict=True)}

    def _together(self, words: list[bytes]) -> dict[bytes, bytes]:
        ids = np.array(self.plain.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.nonzero(self.closes[ids])[0] + 1)).tolist()
        if len(ends) != len(words):
            return self._each(words)
        packed = ids.tobytes()
        return {word: packed[start:end] for word, start, end in zip(words, [0, *ends[:-1]], ends, strict=True)}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, other = [], []
        for word in words:
            text = word.decode()
            simple = text.isalpha() and text.islower() and (word.isascii() or (max(text) < LATIN_END and is_normalized("NFC", text)))
            (plain if simple else other).append(word)
        return (self._together(plain) if plain else {}) | (self._each(other) if other else {})

    def ids(self, raw: bytes) -> bytes:
        words = (raw if b"<|" in raw else raw.lower()).split()
        new = [word for word in dict.fromkeys(words) if word not in self.known]
        if not new:
            return b"".join(map(self.known.__getitem__, words))
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(dict.fromkeys(words))
        split = {}
        for word in new:
            stem = word.rstrip(CLOSING)
            split[word] = (stem, word[len(stem) :]) if 0 < len(stem) < len(word) and stem.decode().lower()[-1].isalpha() else (word,)
        parts = dict.fromkeys(part for both in split.values() for part in both)
        self.known.update(self._encode([part for part in parts if part not in self.known]))
        for word, both in split.items():
            if len(both) > 1:
                self.known[word] = self.known[both[0]] + self.known[both[1]]
        out = b"".join(map(self.known.__getitem__, words))
        for word in [word for word in (*new, *parts) if len(word) > LONGEST]:
            self.known.pop(word, None)
        return out


@lru_cache(maxsize=1)
def _word_tokens(path: str) -> WordTokens:
    """One per Python worker, so that tasks after the first know its words."""
    return WordTokens(path)


def token_reader(path: str, width: int = WIDTH):
    """``bytes -> (token count with the closing 0, CRC-32 of each piece)`` for one task."""
    from zlib import crc32

    tokens, step = _word_tokens(path), 4 * width

    def read(raw: bytes) -> tuple[int, list[int]]:
        ids = tokens.ids(raw) + bytes(4)
        return len(ids) // 4, [crc32(ids[at : at + step]) for at in range(0, len(ids), step)]

    return read


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: pieces of at most ``width`` tokens of every row."""
    read = per_text(lambda: token_reader(tokenizer, width), "n bigint, sums array<bigint>")
    counted = docs.select(F.col(doc_id).alias("doc_id"), read(text_bytes(text)).alias("t"))
    listed = counted.select("doc_id", F.col("t.n").alias("n"), F.posexplode("t.sums").alias("piece", "ids_crc32"))
    start = (F.col("piece") * width).cast("bigint")
    return listed.select("doc_id", "piece", start.alias("start"), F.least(F.lit(width), F.col("n") - start).alias("length"), "ids_crc32")


def best_fit(lengths: list[int], width: int = WIDTH) -> list[list[int]]:
    """Bins (lists of item numbers) by best-fit decreasing; bins wait by their free space."""
    bins: list[list[int]] = []
    waiting: list[list[int]] = [[] for _ in range(width + 1)]
    spaces = 0
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[item]
        fitting = spaces >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = waiting[free].pop()
            if not waiting[free]:
                spaces ^= 1 << free
            bins[number].append(item)
            free -= size
        else:
            number, free = len(bins), width - size
            bins.append([item])
        if free:
            waiting[free].append(number)
            spaces |= 1 << free
    return bins


def _exchange(taker: list[int], giver: list[int], least: int, gap: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The best exchange between two bins given as sorted lengths.

    (gain, lengths taken from ``giver``, lengths given back); the gain of the taker is at least
    ``least``, so that squared fill rises, and at most ``gap``.
    """
    best: tuple[int, tuple[int, ...], tuple[int, ...]] = (least - 1, (), ())
    back: list[tuple[int, ...]] = [(), *((y,) for y in dict.fromkeys(taker))]
    for given in back:
        most = gap + sum(given)
        place = bisect_right(giver, most) - 1
        if place >= 0 and giver[place] - sum(given) > best[0]:
            best = (giver[place] - sum(given), (giver[place],), given)
        if given:
            for k, x in enumerate(giver):
                place = bisect_right(giver, most - x) - 1
                place -= place == k
                if place > k and x + giver[place] - given[0] > best[0]:
                    best = (x + giver[place] - given[0], (x, giver[place]), given)
        if best[0] == gap:
            return best
    for k, x in enumerate(giver):
        for m, y in enumerate(taker):
            place = bisect_left(taker, x - gap - y)
            place += place == m
            if place < len(taker) and place > m and 0 < x - y - taker[place] and x - y - taker[place] > best[0]:
                best = (x - y - taker[place], (x,), (y, taker[place]))
        if best[0] == gap:
            break
    return best


def improve(bins: list[list[int]], lengths: list[int], width: int = WIDTH, donors: int = DONORS) -> list[list[int]]:
    """Exchange pieces between underfull bins while squared fill rises; drop bins that empty.

    Pieces are taken from the ``donors`` emptiest bins, from the next ones when those admit no
    exchange, and again from the emptiest after one was found, until no bin admits any.
    """
    fewest = -(-sum(lengths) // width)
    full = [b for b in bins if sum(lengths[k] for k in b) == width]
    open_ = [sorted(b, key=lengths.__getitem__) for b in bins if sum(lengths[k] for k in b) < width]
    fill = [sum(lengths[k] for k in b) for b in open_]
    first = 0
    while sum(1 for b in open_ if b) + len(full) > fewest:
        moved = False
        order = sorted((k for k in range(len(open_)) if open_[k] and fill[k] < width), key=lambda k: fill[k])
        givers = order[first : first + donors]
        if not givers:
            break
        for a in reversed(order[1:]):
            for b in givers:
                if a == b or not open_[b] or not open_[a] or fill[b] > fill[a] or fill[a] == width:
                    continue
                gain, taken, given = _exchange([lengths[k] for k in open_[a]], [lengths[k] for k in open_[b]], 1, width - fill[a])
                if gain < 1 or not taken:
                    continue
                out, into = [], []
                for wanted, place, side in ((taken, open_[b], out), (given, open_[a], into)):
                    for size in wanted:
                        side.append(place.pop(next(k for k, item in enumerate(place) if lengths[item] == size)))
                open_[a] = sorted(open_[a] + out, key=lengths.__getitem__)
                open_[b] = sorted(open_[b] + into, key=lengths.__getitem__)
                fill[a] += gain
                fill[b] -= gain
                moved = True
            if sum(1 for k in givers if open_[k]) == 0:
                break
        first = 0 if moved else first + donors
    return full + [b for b in open_ if b]


def pack_lengths(lengths: list[int], width: int = WIDTH) -> list[list[int]]:
    """Bins of item numbers; each holds at most ``width``."""
    return improve(best_fit(lengths, width), lengths, width)


def _pack_block(width: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        block = pa.Table.from_batches(held).combine_chunks()
        lengths = block["length"].to_pylist()
        bin_of, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        for number, items in enumerate(pack_lengths(lengths, width)):
            at = 0
            for item in items:
                bin_of[item], offset[item] = number, at
                at += lengths[item]
        sequence = (np.asarray(block["block"].to_numpy(), dtype=np.int64) << 32) + bin_of
        out = block.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=10_000)

    return pack


def pack_documents(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, width: int = WIDTH, block: int = BLOCK
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document is its token ids and one 0, so null and empty texts are one piece of length one.
    Only longer documents are cut.  Rows that repeat an id are packed like others.  An empty
    table gives an empty result.
    """
    listed, rows = materialize(pieces(docs, tokenizer, doc_id, text, width))
    dealt = listed.repartition(max(1, -(-rows // block))).withColumn("block", F.spark_partition_id())
    id_type = listed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return dealt.mapInArrow(_pack_block(width), schema)
