"""Language-model scores from sharded Elias-Fano tries.

A bigram model with absolute discounting over an add-one unigram model:
P(w | c) = max(n(c,w) - D, 0) / n(c) + D t(c) / n(c) P(w), where t(c) counts
the distinct followers of c, and P(w) = (n(w) + 1) / (N + V + 1). A context not
met in training leaves P(w). Each text is its words and one end; the first
word's context is the start.

Documents are coded in chunks. A chunk sends each of its distinct words and
bigrams once, with its training counts, to the shards that own them. A shard
adds up all chunks, builds its trie and answers every chunk that asked: so the
model is never in one place, and what travels is a chunk's distinct n-grams,
not the tokens. A context's followers are spread over FAN shards, so that a
very common context fills none. Words are counted by 64-bit hashes; tries hold
40 bits of a context's and 32 of a follower's, counted for each context apart.

Null and empty texts are one end. A null id counts as an empty text's hash
(training). Repeated rows count each time. Extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm import chunks
from boxwright.llm.elias_fano import Trie, dequantised
from boxwright.session import cut

CHUNK_CHARS = 16_000_000
DISCOUNT = 0.75
FAN = 2
#: Shards a shuffle partition; a shard is what one task holds at a time.
SHARDS = 3
FOLDS, HELD_OUT = 7, 2
START, END = 0, 1  # codes in every chunk; words follow


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _bigrams(coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of some texts with their ends, the bigrams they end, and where each text begins."""
    lens = np.array([len(c) + 1 for c in coded], np.int64)
    ends = np.cumsum(lens)
    tokens = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint32)
    inner = np.ones(len(tokens), bool)
    inner[ends - 1] = False
    tokens[inner] = np.concatenate(coded) if coded else []
    keys = np.empty(len(tokens), np.uint64)
    keys[1:] = tokens[:-1]
    keys[ends - lens] = START
    keys <<= np.uint64(32)
    keys |= tokens
    return tokens, keys, ends - lens


def _layout(pairs: np.ndarray, hashes: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shard: a chunk's words, its contexts with how many followers they have there, and its bigrams.

    A context goes to all FAN shards that its followers can be in, those where
    the chunk has none of them included, as its followers are counted in each.
    """
    context, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    base = hashes % np.uint64(1_000_003) * np.uint64(FAN)
    pair_shard = ((base[context] + (hashes[word] & np.uint64(FAN - 1))) % np.uint64(n)).astype(np.uint32)
    distinct = np.unique(context)
    both = np.concatenate([((base[distinct] + np.uint64(j)) % np.uint64(n)).astype(np.uint32) for j in range(FAN)])
    by = lambda shard: (np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=n))]).tolist())
    (words, w), (some, p), (contexts, c) = by((hashes % np.uint64(n)).astype(np.uint32)), by(pair_shard), by(both)
    for k in range(n):
        mine = np.unique(distinct[contexts[c[k] : c[k + 1]] % len(distinct)]) if len(distinct) else distinct
        of = some[p[k] : p[k + 1]]
        yield words[w[k] : w[k + 1]], mine, np.bincount(np.searchsorted(mine, context[of]), minlength=len(mine)), of


def _context(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - Trie.CONTEXT_BITS)


def _follower(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - Trie.FOLLOWER_BITS)


#: Bytes kept of: word hash, training count; context hash, followers of it; follower, training count.
ASKED = (8, 4, 5, 4, 4, 4)
#: Of an answer: training count of each word; followers in total of each context; code of each bigram.
ANSWERED = (6, 5, 2)


def _ask(n_shards: int):
    """Renumbers a chunk's codes by hash and makes its blobs: -1 - k are the hashes, 0... go to the shards."""

    def run(ids: list, coded: list[np.ndarray], words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        own = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        order = np.argsort(own)
        rank = np.empty(len(own), np.uint32)
        rank[order] = np.arange(2, len(own) + 2)
        for i, c in enumerate(coded):
            coded[i] = rank[c]
        hashes = np.concatenate([np.array([START, END], np.uint64), own[order]])
        yield -1, chunks.blob((hashes, 8))
        tokens, keys, begins = _bigrams(coded)
        train = np.repeat(np.array([not held_out(i) for i in ids], np.uint32), np.diff(np.append(begins, len(tokens))))
        n_word = np.bincount(tokens, weights=train, minlength=len(hashes)).astype(np.uint64)
        pairs, at = np.unique(keys, return_inverse=True)
        del keys
        n_pair = np.bincount(at, weights=train, minlength=len(pairs)).astype(np.uint64)
        for k, (w, mine, followers, p) in enumerate(_layout(pairs, hashes, n_shards)):
            follower = _follower(hashes[(pairs[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)])
            yield k, chunks.blob((hashes[w], 8), (n_word[w], 4), (_context(hashes[mine]), 5), (followers, 4), (follower, 4), (n_pair[p], 4))

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard: its model from all chunks, then what each chunk asked for. First row: its tokens and distinct words."""
    asked = [chunks.unblob(b, *ASKED)[0] for b in rows["payload"]]
    words, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    n_word = np.bincount(at, weights=np.concatenate([a[1] for a in asked]).astype(np.float64), minlength=len(words)).astype(np.uint64)
    context = np.concatenate([np.repeat(a[2], a[3].astype(np.int64)) for a in asked])
    follower, count = np.concatenate([a[4] for a in asked]), np.concatenate([a[5] for a in asked])
    seen = count > 0
    context, follower, count = context[seen], follower[seen], count[seen]
    order = np.lexsort((follower, context))
    context, follower, count = context[order], follower[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (follower[1:] != follower[:-1])])) if len(context) else np.zeros(0, np.int64)
    trie = Trie(context[first], follower[first], np.add.reduceat(count, first) if len(first) else count)
    out, begin = [], 0
    for a in asked:
        mine = n_word[at[begin : begin + len(a[0])]]
        begin += len(a[0])
        totals, codes = trie.find(a[2], np.repeat(np.arange(len(a[2])), a[3].astype(np.int64)), a[4])
        out.append(chunks.blob((mine, 6), (totals, 5), (codes, 2)))
    part = rows["part"].iloc[0]
    total = pd.DataFrame({"chunk": [None], "part": [part], "payload": [None], "tokens": [int(n_word.sum())], "words": [int((n_word > 0).sum())]})
    return pd.concat([total, pd.DataFrame({"chunk": rows["chunk"], "part": part, "payload": out, "tokens": 0, "words": 0})])


def _score(n_shards: int, tokens_total: int, words_total: int):
    counts = dequantised()

    def run(doc_rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        (hashes,), _ = chunks.unblob(answers["payload"][answers["part"] == -1].iloc[0], 8)
        found = {p: chunks.unblob(b, *ANSWERED)[0] for p, b in zip(answers["part"], answers["payload"], strict=True) if p >= 0}
        ids, coded = chunks.documents_of(doc_rows)
        tokens, keys, begins = _bigrams(coded)
        pairs, at = np.unique(keys, return_inverse=True)
        del keys
        n_word, followers, code = np.zeros(len(hashes)), np.zeros(len(hashes)), np.zeros(len(pairs), np.int64)
        for k, (w, mine, _, p) in enumerate(_layout(pairs, hashes, n_shards)):
            n_word[w], code[p] = found[k][0], found[k][2]
            followers[mine] += found[k][1]
        context = (pairs >> np.uint64(32)).astype(np.int64)
        plain = np.log10((n_word + 1) / (tokens_total + words_total + 1))
        n_context = n_word.copy()
        n_context[START] = n_word[END]
        word = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        n = np.maximum(n_context[context], 1)
        smooth = np.maximum(counts[code] - DISCOUNT, 0) / n + DISCOUNT * followers[context] / n * 10 ** plain[word]
        pair_score = np.where((n_context[context] > 0) & (followers[context] > 0), np.log10(np.maximum(smooth, 1e-300)), plain[word])
        t = tokens
        sums = lambda x: np.add.reduceat(x, begins) if len(begins) else x
        return pd.DataFrame(
            {
                "doc_id": pd.Series(ids, dtype="Int64"),
                "held_out": [held_out(i) for i in ids],
                "n_tokens": sums(np.ones(len(t), np.int64)),
                "n_known": sums((n_word[t] > 0).astype(np.int64)),
                "train_tokens": tokens_total,
                "base_score": sums(plain[t]),
                "score": sums(pair_score[at]),
            }
        )

    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _words() -> object:
    return lambda text: text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits


def scores(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, n_shards: int | None = None) -> DataFrame:
    """Train on all but the held-out fold and score every document; rows of SCORES."""
    n = n_shards or SHARDS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = chunks.code_documents(docs, _words, _ask(n), "lm-chunks", chunk_chars)
    answers = cut(coded.asked().groupBy("part").applyInPandas(_answer, "chunk string, part int, payload binary, tokens bigint, words bigint"), "lm-answers")
    totals = answers.filter("chunk is null").agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    coded.drop_asked()
    sent = coded.own().union(answers.filter("chunk is not null").select("chunk", "part", "payload"))
    return coded.documents().groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInPandas(_score(n, totals["n"] or 0, totals["v"] or 0), SCORES)
