"""Language-model scoring: corpus counts and a causal self-attention model from the training documents, and every document's log probability."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, id_fold, kept, packed, parts, small_batches, spill, summed, table, take_over

#: Words with so many ranks are looked up in memory by every task; the counts of all others are joined.
SENT_WORDS = 100_000
#: A trainer has so many windows at least, and holds and shuffles so many at once.
PER_TRAINER, HELD_WINDOWS = 30_000, 1 << 15
#: Learning rates of the rounds; between rounds the trainers' weights are averaged.
RATES = (0.01, 0.006, 0.003, 0.001)
#: A chunk takes texts until it has so many bytes. Words are told apart, encoded and counted in so many chunks at once.
CHUNK_BYTES, TOGETHER = 2 << 20, 4
_CHUNK = "kind int, docs binary, words binary, hashes binary, lengths binary, ids binary, word long, n long, blob binary"


def _spans(lengths, at):
    """Where the items of the groups ``at`` are, among the items of all groups, of which there are so many in each."""
    import numpy as np

    own = lengths[at]
    before = np.cumsum(own) - own
    return np.arange(int(own.sum())) + np.repeat((np.cumsum(lengths) - lengths)[at] - before, own)


def _cut(texts):
    """A column of texts to their words, A-Z lower-cased: the distinct ones, each word's place among these, and how many words each text has."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes, found = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
    own, places = found.dictionary.cast(pa.large_binary()).to_pylist(), found.indices.to_numpy()
    if b"" in own:  # before white space at the start of a text, and behind it at the end
        empty = own.index(b"")
        word = places != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[word], minlength=len(sizes))
        places = places[word]
        places = places - (places > empty)
        own.pop(empty)
    return own, places, sizes


#: White space beyond ASCII.
_WIDE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class _Words:
    """Subword ids of words with a space before them."""

    def __init__(self, name: str):
        import numpy as np
        import public_tokenizers
        import tiktoken

        from .bpe import read_ranks

        ranks = read_ranks(public_tokenizers.path(name) if "/" not in name else name)
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.bytes_of = np.zeros(self.size, np.int64)
        self.bytes_of[list(ranks.values())] = list(map(len, ranks))

    def encoded(self, words: list[bytes]):
        """The words' ids, one word after the other, and how many each has.

        A match of the pattern never goes on from one word into the space before the next, unless there is white space beyond ASCII
        in them; so the words are encoded as one text and its ids dealt out by their bytes. With such white space it is word by word.
        """
        import numpy as np

        text = " " + b" ".join(words).decode()
        if not any(x in text for x in _WIDE):
            ids = self.encoding.encode_to_numpy(text, disallowed_special=())
            last = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))
            return ids.astype(np.uint16), np.diff(last, prepend=-1)
        each = [self.encoding.encode_ordinary(" " + w.decode()) for w in words]
        return np.array([i for x in each for i in x], np.uint16), np.array([len(x) for x in each], np.int64)


@kept("lm-words")
def _words(name: str) -> _Words:
    return _Words(name)


def _prepare(name: str):
    """(doc_id, held_out, text) rows to chunks of texts as word numbers, with the chunk's words (kind 0), word counts (1) and id counts (2) of training texts."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        fields = {"kind": pa.int32()} | dict.fromkeys(("docs", "words", "hashes", "lengths", "ids"), pa.binary()) | {"word": pa.int64(), "n": pa.int64(), "blob": pa.binary()}

        def rows(kind, count, **columns):
            got = {"kind": pa.array(np.full(count, kind, np.int32))} | {k: pa.array(x, fields[k]) for k, x in columns.items()}
            return pa.RecordBatch.from_arrays([got[k] if k in got else pa.nulls(count, t) for k, t in fields.items()], names=list(fields))

        take_over("lm-words")
        words = _words(name)
        id_counts = np.zeros(words.size + 1, np.int64)

        def chunks():
            """The held texts' chunks, and the counts of their words."""
            docs, out, texts = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
            out = out.cast(pa.int64()).to_numpy()
            own, places, sizes = _cut(texts)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)).view(np.int64)
            ids, lengths = words.encoded(own) if own else (np.empty(0, np.uint16), np.empty(0, np.int64))
            counts = np.bincount(places[np.repeat(out == 0, sizes)], minlength=len(own))
            id_counts[:-1] += np.bincount(ids, np.repeat(counts, lengths), words.size).astype(np.int64)
            id_counts[-1] += int((out == 0).sum())
            meta = np.column_stack([docs.fill_null(0).to_numpy(), out, docs.is_valid().cast(pa.int64()).to_numpy(), sizes]).astype(np.int64)
            word, first = np.concatenate([[0], np.cumsum(sizes)]), 0
            for last in cuts:
                at = places[word[first] : word[last]]
                there = np.zeros(len(own), bool)
                there[at] = True
                mine = np.flatnonzero(there)
                yield rows(
                    0, 1, docs=[meta[first:last].tobytes()], words=[(np.cumsum(there) - 1)[at].astype(np.uint32).tobytes()], hashes=[hashes[mine].tobytes()],
                    lengths=[lengths[mine].astype(np.uint32).tobytes()], ids=[ids[_spans(lengths, mine)].tobytes()],
                )
                first = last
            n = np.flatnonzero(counts)
            yield rows(1, len(n), word=hashes[n], n=counts[n])

        held, cuts, size, count = [], [], 0, 0
        for batch in batches:
            first = 0
            for i, n in enumerate(pc.binary_length(batch.column(2)).to_pylist()):
                size += n + 50
                if size > CHUNK_BYTES:
                    cuts.append(count + i + 1 - first)
                    size = 0
                    if len(cuts) == TOGETHER:
                        held.append(batch.slice(first, i + 1 - first))
                        yield from chunks()
                        held, cuts, count, first = [], [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
                count += batch.num_rows - first
        if held:
            if count > (cuts or [0])[-1]:
                cuts.append(count)
            yield from chunks()
        if id_counts.any():
            yield rows(2, 1, blob=[packed(id_counts)])

    return run


class _Chunk:
    """A chunk's texts: ``docs`` (id, held out, whether there is an id, number of words), words as numbers of its own words."""

    def __init__(self, docs: bytes, words: bytes, hashes: bytes, lengths: bytes, ids: bytes):
        import numpy as np

        self.docs = np.frombuffer(docs, np.int64).reshape(-1, 4)
        self.words, self.hashes = np.frombuffer(words, np.uint32), np.frombuffer(hashes, np.int64)
        self.lengths, self.ids = np.frombuffer(lengths, np.uint32).astype(np.int64), np.frombuffer(ids, np.uint16)

    @classmethod
    def of(cls, batch) -> Iterator[_Chunk]:
        """Of the binary columns docs, words, hashes, lengths, ids."""
        for i in range(batch.num_rows):
            yield cls(*(batch.column(j)[i].as_py() for j in range(5)))

    def tokens(self, take):
        """The ids of the texts marked, one after the other, and their numbers by text."""
        import numpy as np

        sizes = self.docs[:, 3]
        words = self.words[np.repeat(take, sizes)]
        ends = np.concatenate([[0], np.cumsum(self.lengths[words])])
        return self.ids[_spans(self.lengths, words)].astype(np.int32), np.diff(ends[np.concatenate([[0], np.cumsum(sizes[take])])])


_SENT = ("docs", "words", "hashes", "lengths", "ids")


def _count_pairs(sent):
    """Chunks to the counts of ids after classes, in training texts, with a column for each id that occurs in them."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import attention as A

        take_over("lm")
        vocab, there = sent.value
        column = np.zeros(len(vocab.cls), np.int64)
        column[there] = np.arange(len(there))
        pairs = np.zeros(vocab.classes * len(there), np.int32)  # a task's own; sums of tasks have 64 bits
        for batch in batches:
            for chunk in _Chunk.of(batch):
                flat, sizes = chunk.tokens(chunk.docs[:, 1] == 0)
                x, y, _ = A.rows(flat, sizes, vocab, A.BLOCK)
                x, y = x[y >= 0], y[y >= 0]
                np.add.at(pairs, vocab.cls[x].astype(np.int64) * len(there) + column[y], np.int32(1))
        if pairs.any():
            yield pa.RecordBatch.from_arrays([pa.array([packed(pairs.astype(np.int64))], pa.binary())], names=["blob"])

    return run


def _train_round(sent, weights: bytes, turn: int):
    """Chunks to a trainer's weights after the texts of this turn, times the number of their windows, and the number. Each training text has one turn, by its place."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import attention as A

        take_over("lm")
        p, state, held, size, done = A.unpack(np.frombuffer(weights, np.float32)), {}, [], 0, 0

        def learn():
            nonlocal held, size, done
            ins, outs = (np.concatenate(x) for x in zip(*held, strict=True))
            A.learn(p, sent.value, ins, outs, RATES[turn], seed=turn, state=state)
            held, size, done = [], 0, done + len(ins)

        for batch in batches:
            for chunk in _Chunk.of(batch):
                place = np.arange(len(chunk.docs)) + int(chunk.docs[0, 0])
                flat, sizes = chunk.tokens((chunk.docs[:, 1] == 0) & (place % len(RATES) == turn))
                if len(sizes):
                    held.append(A.rows(flat, sizes, sent.value, 2 * A.BLOCK)[:2])
                    size += len(held[-1][0])
                if size >= HELD_WINDOWS:
                    learn()
        if size:
            learn()
        if done:
            flat = np.append(A.pack(p).astype(np.float64) * done, float(done))
            yield pa.RecordBatch.from_arrays([pa.array([packed(flat)], pa.binary())], names=["x"])

    return run


def _score(sent, weights: bytes, hot, floor: float):
    """Chunks to (doc_id, held_out, n_tokens, n_known, base, score, rare, times) rows; rare: the hashes of words whose counts aren't in memory, once by text; times: how often they are there."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import attention as A

        take_over("lm")
        known, value = hot.value
        scorer = A.Scorer(A.unpack(np.frombuffer(weights, np.float32)), sent.value)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"]
        for batch in batches:
            for chunk in _Chunk.of(batch):
                sizes, n = chunk.docs[:, 3], len(chunk.docs)
                scores = scorer.score(*chunk.tokens(np.full(n, True)), 128)
                at = np.minimum(np.searchsorted(known, chunk.hashes), max(len(known) - 1, 0))
                found = known[at] == chunk.hashes if len(known) else np.zeros(len(chunk.hashes), bool)
                base = np.where(found, value[at], 0.0)[chunk.words] if len(known) else np.zeros(len(chunk.words))
                told = found[chunk.words]
                doc = np.repeat(np.arange(n), sizes)
                counts = np.bincount(doc, told, n).astype(np.int64)
                wide = max(len(chunk.hashes), 1)
                cells, times = np.unique(doc[~told] * wide + chunk.words[~told], return_counts=True)
                offsets = pa.array(np.searchsorted(cells, np.arange(n + 1) * wide).astype(np.int32))
                rare, times = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (chunk.hashes[cells % wide], times))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk.docs[:, 0], pa.int64(), mask=chunk.docs[:, 2] == 0), pa.array(chunk.docs[:, 1] == 1), pa.array(sizes + 1), pa.array(counts),
                        pa.array(np.bincount(doc, base, n) + floor, pa.float64()), pa.array(scores, pa.float64()), rare, times,
                    ],
                    names=names,
                )

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are taken with A-Z lower-cased, as words between ASCII white space and one end. A null text is empty
    and has the end alone. Rows whose id has crc32 % folds = 0 are held out; a null id is the empty text there.
    Repeated rows count, and are scored, as often as they occur. Without training texts the counts are
    0, base_score is that of a word never seen and the network has its initial weights. Other columns are not read.

    1. One pass cuts all texts, writes them in chunks, as numbers of the chunk's words, and counts words and ids of the
       training texts. Word counts are added up by task before they are shuffled.
    2. Two passes over the training texts count ids after frequent ids, by which the classes are grouped, and ids after
       classes. Then trainers learn side by side, each from texts of its own, and are averaged between rounds.
       Every training text is learned from once, in one of the rounds, whatever the corpus size.
    3. A last pass scores: the network batch by batch, the base by a table of the most frequent words. The other
       words' counts are joined to the texts by word and summed by text.

    Words are told apart by 64-bit hashes.
    """
    import numpy as np

    from . import attention as A

    spark = docs.sparkSession
    sc = spark.sparkContext
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_fold(F.col(id_col), folds) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = spill(own.mapInArrow(_prepare(vocabulary), _CHUNK), "lm-texts", ("kind",), "zstd", long_rows=True)
    chunks = made.where("kind = 0").select(*_SENT)
    words = spill(made.where("kind = 1").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    size = _vocabulary_size(vocabulary)
    counts = summed(made.where("kind = 2").select("blob"), "int64")
    counts = np.zeros(size + 1, np.int64) if counts is None else counts
    ends = int(counts[-1])
    stat = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n, v = stat.n + ends, stat.v + (ends > 0)
    top = words.orderBy(F.desc("n"), "word").limit(SENT_WORDS).toPandas().sort_values("word")
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    hot = sc.broadcast((top.word.to_numpy(np.int64), np.log10(top.n.to_numpy(float) + 0.1) - math.log10(n + 0.1 * (v + 1))))

    vocab, pairs, grouped = A.vocabulary(counts.astype(np.float64)), None, False
    there = np.flatnonzero(counts)
    for _ in range(2):
        sent = sc.broadcast((vocab, there))
        found = summed(chunks.mapInArrow(_count_pairs(sent), "blob binary"), "int64")
        sent.destroy()
        if found is not None:
            pairs = np.zeros((vocab.classes, size + 1), np.int64)
            pairs[:, there] = found.reshape(vocab.classes, len(there))
        if not grouped and pairs is not None:
            vocab, grouped = A.vocabulary(counts.astype(np.float64), pairs[:, :-1]), True
    sent = sc.broadcast(vocab)
    trainers = max(1, int(counts.sum()) // (2 * A.BLOCK) // PER_TRAINER)  # at most one for each piece of the texts' files
    weights = A.pack(A.fresh()).astype(np.float32)
    learned = chunks.coalesce(trainers)
    for turn in range(len(RATES) if pairs is not None else 0):
        mean = summed(learned.mapInArrow(_train_round(sent, weights.tobytes(), turn), "x binary"), "float64")
        if mean is not None:
            weights = (mean[:-1] / mean[-1]).astype(np.float32)
    sent.destroy()
    if pairs is not None:
        vocab.condition(pairs)
    sent = sc.broadcast(vocab)

    scored = chunks.mapInArrow(
        _score(sent, weights.tobytes(), hot, log(ends)), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>"
    ).withColumn("rid", F.monotonically_increasing_id())
    scored = spill(scored, "lm-scores")
    discard(made)
    sent.destroy()
    hot.destroy()
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    c = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.join(words, "word", "left").groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("k"), F.sum(F.col("k") * (F.log10(c + 0.1) - F.lit(math.log10(n + 0.1 * (v + 1))))).alias("b")
    )
    return scored.join(rare, "rid", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), "score",
    )


def _vocabulary_size(name: str) -> int:
    import public_tokenizers

    with open(public_tokenizers.path(name) if "/" not in name else name, "rb") as f:
        return max(int(line.split()[1]) for line in f if line.strip()) + 1


def op1_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)  # a chunk has megabytes: else some ten of them go to a worker at once
    return score_texts(table(spark, sf_dir, "documents"))
