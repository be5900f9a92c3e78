"""SentencePiece encoding and decoding by shared-prefix Viterbi over the distinct marked words of a batch."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The public vocabulary file that the query uses; a parameter, never copied.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A marked word: spaces (the marks) and what follows them up to the next space. No piece of the vocabulary has a mark after another character.
MARKED = re.compile(" +[^ ]*|[^ ]+")
#: What an unknown character costs below the least score; distinct words after which a task's memory of words ages (twice as many are held at most).
UNKNOWN, REMEMBERED = 10.0, 250_000
#: Bytes of text that are in work at a time; a longer text is in work alone.
IN_WORK = 6_000_000


class Vocabulary:
    """Pieces and scores of a SentencePiece file, as a trie of dictionaries; with byte pieces for unknown characters.

    A mark is held as the space that it stands for, so that a text's own U+2581 is an unknown character, which byte
    pieces spell, and comes back as itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.unknown = model.unk_id()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        usual = [i for i in range(len(self.pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.least = min(model.get_score(i) for i in usual)
        self.trie: dict = {}
        for i in usual:
            node = self.trie
            for c in self.pieces[i].replace(MARK, " "):
                node = node.setdefault(c, {})
            node[""] = (model.get_score(i), i)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.spelled = [p.replace(MARK, " ") for p in self.pieces]

        self.unseen = (1, self.least - UNKNOWN, self.unknown)
        self.start: list = [{}, (), ()]
        self.states: dict[int, list] = {}

    def step(self, state: list, c: str) -> list:
        """The state after one more character, made when it is first needed.

        A state stands for all walks through the vocabulary that are alive at a place of a word: transitions, the
        pieces that end there (length, score, number; longest first), and the walks (length, trie node). The
        longest walk determines the others, so there are no more states than trie nodes.
        """
        alive = [(n + 1, node[c]) for n, node in (*state[2], (0, self.trie)) if c in node]
        if not alive:
            return self.start
        found = self.states.get(id(alive[0][1]))
        if found is None:
            found = self.states[id(alive[0][1])] = [{}, tuple((n, *node[""]) for n, node in alive if "" in node), tuple(alive)]
        state[0][c] = found
        return found

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Best segmentation of each word: the largest sum of scores; of equal ones the first found from the left.

        The words are sorted, so that they come as a depth-first walk of their trie: what a word shares with the one
        before it, forward scores and where the vocabulary's walks stand, is kept on a stack.
        """
        out: dict[str, tuple[int, ...]] = {}
        cost, unseen, last = self.unseen[1], self.unseen, ""
        best, back, states = [0.0], [unseen], [self.start]
        for word in sorted(set(words)):
            depth, limit = 0, min(len(word), len(last))
            while depth < limit and word[depth] == last[depth]:
                depth += 1
            del best[depth + 1 :], back[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            for at in range(depth, len(word)):
                c = word[at]
                state = state[0].get(c) or self.step(state, c)
                score, piece = best[at] + cost, unseen
                for found in state[1]:
                    s = best[at + 1 - found[0]] + found[1]
                    if s > score or s == score and piece is unseen:
                        score, piece = s, found
                best.append(score)
                back.append(piece)
                states.append(state)
            ids, at = [], len(word)
            while at:
                piece = back[at]
                at -= piece[0]
                if piece is unseen and self.bytes:
                    ids += [self.bytes[b] for b in reversed(word[at].encode("utf-8", "surrogatepass"))]
                else:
                    ids.append(piece[2])
            ids.reverse()
            out[word] = tuple(ids)
            last = word
        return out

    def spell(self, ids: Sequence[int]) -> str:
        """What pieces spell: runs of byte pieces are UTF-8, marks are spaces."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.spelled[i] for i in ids])
        parts, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                parts.append(self.spelled[i])
        if run:
            parts.append(run.decode("utf-8", "replace"))
        return "".join(parts)

    def decode(self, ids: Sequence[int]) -> str:
        """Text of the pieces, without the dummy prefix (the first mark)."""
        text = self.spell(ids)
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def slices(batches: Iterator[pa.RecordBatch], column: int, weight) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about IN_WORK by the weight of their rows, so that what is in work at a time is bounded."""
    for batch in batches:
        weights = np.cumsum(np.nan_to_num(weight(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(weights, (weights[start - 1] if start else 0) + IN_WORK, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def marked_words(texts: pa.Array) -> pa.Array:
    """List of each text's marked words, each without its first mark; none for null and empty texts."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # a copy: pc.if_else reads beyond the start of a slice
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), None, texts)
    runs = pc.fill_null(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), False)
    plain = pc.split_pattern(pc.if_else(runs, None, texts), " ")
    if not pc.any(runs).as_py():
        return plain
    # Runs of spaces belong to the word after them: these few texts are split by the pattern.
    at = np.flatnonzero(runs.to_numpy(zero_copy_only=False))
    odd = pa.array([[w[1:] for w in MARKED.findall(" " + t)] for t in texts.take(pa.array(at)).to_pylist()], plain.type)
    place = np.arange(len(texts))
    place[at] = len(texts) + np.arange(len(at))
    return pa.concat_arrays([plain, odd]).take(pa.array(place))


class Memory:
    """Pieces of the words that a task met last, and what they decode to where that is not the word itself; two generations of bounded size."""

    def __init__(self, v: Vocabulary):
        self.v, self.young, self.old, self.other = v, {}, {}, {}

    def of(self, words: list[str]) -> list[tuple[int, ...]]:
        """Pieces of each marked word, given without its first mark."""
        young, old = self.young, self.old
        if len(young) > REMEMBERED:
            self.old, self.young, self.other = young, {}, {w: t for w, t in self.other.items() if w in young}
            young, old = self.young, self.old
        new = []
        for w in words:
            if w not in young:
                ids = old.get(w)
                if ids is None:
                    new.append(" " + w)
                else:
                    young[w] = ids
        for marked, ids in self.v.encode_words(new).items():
            young[marked[1:]] = ids
            if (text := self.v.spell(ids)) != marked:
                self.other[marked[1:]] = text
        return [young[w] for w in words]

    def decoded(self, words: list[str]) -> list[str]:
        """The texts that the words' pieces decode to, with their first mark."""
        return [self.other.get(w, " " + w) for w in words] if self.other else [" " + w for w in words]


def encoded(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[tuple[pa.Array, pa.ListArray, pa.Array]]:
    """Per slice of (id, text) batches: the ids, each text's pieces, and what they decode to.

    Arrow splits the texts and numbers their distinct words; only words that the task doesn't remember are segmented,
    and decoded from their pieces, in Python. No piece goes over a mark, so a text's pieces are its words' in order.
    """
    memory = Memory(v)
    for batch in slices(batches, 1, pc.binary_length):
        lists = marked_words(batch.column(1))
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)))).astype(np.int32)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        each = memory.of(words)
        sizes = np.fromiter(map(len, each), np.int32, len(each))
        flat = np.fromiter(chain.from_iterable(each), np.int32, int(sizes.sum()))
        by_word = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat)).take(coded.indices)
        to = np.concatenate(([0], np.cumsum(by_word.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
        pieces = pa.ListArray.from_arrays(pa.array(to[ends]), by_word.flatten())
        spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pa.array(memory.decoded(words), pa.string()).take(coded.indices)), "")
        yield batch.column(0), pieces, pc.utf8_slice_codeunits(spelled, 1)
    # The worker waits for its next task with what it holds now: it gives back what Arrow keeps for later.
    del memory
    pa.default_memory_pool().release_unused()


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids) per row of docs.

    A text gets a dummy prefix and its spaces become marks; no other normalisation (the file's is identity). Null
    and empty texts have no pieces; a null doc_id is as good as any, repeated rows are encoded alike, extra columns
    are not read. A U+2581 of the text is no mark: byte pieces spell it. Marked words are independent, as no piece
    goes over a mark, so each distinct word of a slice is segmented once; a bounded memory carries words over to
    the task's next slices. Row by row: no shuffle; whole texts. The model file must lie at the same path on every executor.
    """
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, pieces, _ in encoded(batches, vocabulary(model)):
            yield pa.RecordBatch.from_arrays([ids, pieces.value_lengths().cast(pa.int64()), pieces], names=["doc_id", "n_pieces", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(coded, "doc_id long, n_pieces long, ids array<int>")


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids, text) per row of coded (doc_id, n_pieces, ids): the text that the pieces spell. Null ids give null."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in slices(batches, 2, pc.list_value_length):
            out = [None if ids is None else v.decode(ids) for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["doc_id", "n_pieces", "ids", "text"])

    return coded.select("doc_id", "n_pieces", "ids").mapInArrow(texts, "doc_id long, n_pieces long, ids array<int>, text string")


def model_path() -> str:
    return os.environ.get("STRANDWORK_PIECES", MODEL)


def encode_and_back(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_chars, decoded_md5) per row of docs: encode() and what decode() makes of it, in one pass; null texts decode to nothing."""
    model = model_path()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, pieces, back in encoded(batches, vocabulary(model)):
            sums = [hashlib.md5(t).hexdigest() for t in back.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pieces.value_lengths().cast(pa.int64()), pieces, pc.utf8_length(back).cast(pa.int64()), pa.array(sums, pa.string())],
                names=["doc_id", "n_pieces", "ids", "decoded_chars", "decoded_md5"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(both, "doc_id long, n_pieces long, ids array<int>, decoded_chars long, decoded_md5 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encode_and_back(spark.read.parquet(f"{sf_dir}/documents.parquet"))
