"""Spelling variant grouping: a variable-length gram index over the corpus's words finds all pairs one edit apart.

Words and their counts come from all texts: tasks count, Spark sums. The gram dictionary is a frequency-pruned trie grown level by
level: a gram of LEAST_GRAM code points is frequent if it occurs in more than FREQUENT of all places, and only frequent grams are
lengthened, up to MOST_GRAM. A word is decomposed at each place into the shortest gram from there on that isn't frequent (or the
longest one), so common beginnings get long grams and rare ones short grams. What a gram is, is told by its own code points.

An edit at a place affects just the grams that cover it; the others are the same in both words. Grams are ordered by frequency,
rarest first. The list of a word's rarest gram serves all edits that don't affect it; the second list serves only edits inside the
first gram, the third those inside the first two, and so on until no place is covered by all grams so far: the word's
affected-gram bound (the most grams that one edit affects) is how many lists it can need beyond the first. So each edit of a word is
looked for in one list, the first one of both words that the edit spares, and a pair is met once. As the edit lies wholly
before or wholly after the spared gram, a list is keyed by the gram with all that is on its other side.

Merging a list: each word gives, for every place that the list serves, what is left without that code point, and itself, as 64-bit
hashes; words that agree are compared by their code points. Words that differ at the same place are all near each other and are
counted as a class, so a list takes time in proportion to its words and no pairs are listed. A list of more than
HOT_LIST words is dealt on by those hashes before the shuffle, so that no task gets it whole.

Defined results: null and empty texts have no words; a null doc_id counts as the empty text in the hash; repeated rows count each; words
of any length and alphabet are handled (where grams leave a place unserved, words are dealt by what is left without its code
point); no words give no rows; other columns are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_table_path
from ..sources.tables import read_table
from .common import _powers, _spans, cut_lineage, light, mix, pieces, ranges, ready, shuffle_partitions

RUN = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
DELETES = 31
FORM_FACTOR = 10

LEAST_GRAM, MOST_GRAM = 2, 5
#: a gram in more than this share of all places of all words (and in more than FREQUENT_LEAST) is frequent, so that a level has
#: 1 / FREQUENT frequent grams at most
FREQUENT, FREQUENT_LEAST = 1 / 20_000, 64
HOT_LIST = 20_000
HELD_WORDS = 400_000
MERGE_ROWS = 60_000

_BASE = 0xD6E8FEB86659FD93


# ---- words ----------------------------------------------------------------------------------------------------------
def _count_words(run: str, least: int, deletes: int | None):
    @light
    def count(batches):
        find = re.compile(f"[{run}]{{{least},}}").findall
        total: dict[str, int] = {}
        crc32 = zlib.crc32

        def rows():
            return pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()),
                                               "n": pa.array(total.values(), pa.int64())})
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch["text"]):
                raw, bounds = data.tobytes().lower(), offsets.tolist()  # bytes: only A-Z are lowered
                for i, a, b in zip(batch["doc_id"].slice(lo, hi - lo).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    begin = crc32(f"{'' if i is None else i}:".encode())
                    for word, n in Counter(find(raw[a:b].decode("utf-8", "replace"))).items():
                        if deletes and (h := crc32(word.encode(), begin)) % deletes == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1:]
                            if len(word) < least:
                                continue
                        total[word] = total.get(word, 0) + n
                if len(total) >= HELD_WORDS:
                    yield rows()
                    total.clear()
        if total:
            yield rows()
    return count


def count_words(docs: DataFrame, run: str = RUN, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                deletes: int | None = DELETES) -> DataFrame:
    """(word, n): maximal runs of the class ``run`` with A-Z lowered and ``least`` code points at least, found ``least_count`` times
    or more. With ``deletes`` a run whose crc32 with its doc_id that number divides loses a code point first."""
    ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_count_words(run, least, deletes), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Words:
    """A batch's words as one array of code points."""

    def __init__(self, column):
        self.column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        text = "".join(self.column.to_pylist())
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.length = pc.utf8_length(self.column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        self.value = mix(self.code.astype(np.uint64), 11)

    def spans(self, start, end) -> np.ndarray:
        return _spans(self.value, start, end, _BASE)


# ---- the gram dictionary --------------------------------------------------------------------------------------------
Dictionary = list  # per gram length from LEAST_GRAM on: (hashes of the frequent grams, rising; their counts)


def _lookup(level, h: np.ndarray) -> np.ndarray:
    """How often each gram occurs, if it is frequent; else 0."""
    hashes, counts = level
    if not len(hashes):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, counts[at], 0)


def decompose(words: Words, dictionary: Dictionary, least: int = LEAST_GRAM):
    """Of each place with ``least`` code points left: (word, place, gram length, gram hash, its count if frequent, whether it would
    be longer if the word were)."""
    places = np.maximum(words.length - least + 1, 0)
    word = np.repeat(np.arange(len(words.length)), places)
    at = ranges(words.start, places)
    end = words.end[word]
    length, count = np.full(len(at), least, np.int64), np.zeros(len(at), np.int64)
    h = np.zeros(len(at), np.uint64)
    going = np.arange(len(at))
    cut = np.zeros(len(at), bool)
    for k, level in enumerate([*dictionary, (np.zeros(0, np.uint64), np.zeros(0, np.int64))]):
        size = least + k
        h[going] = mix(words.spans(at[going], at[going] + size), size)
        length[going] = size
        count[going] = _lookup(level, h[going])
        going = going[count[going] > 0]
        if k >= len(dictionary) - 1:
            break
        short = at[going] + size + 1 > end[going]
        cut[going[short]] = True
        going = going[~short]
    return word, at - words.start[word], length, h, count, cut


def _level_counts(dictionary: Dictionary, least: int):
    """Hashes of the grams one longer than the dictionary's longest, that begin with a frequent one."""
    @light
    def run(batches):
        for batch in batches:
            words, size = Words(batch["word"]), least + len(dictionary)
            at = ranges(words.start, np.maximum(words.length - size + 1, 0))
            if dictionary:
                at = at[_lookup(dictionary[-1], mix(words.spans(at, at + size - 1), size - 1)) > 0]
            h, n = np.unique(mix(words.spans(at, at + size), size), return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})
    return run


def gram_dictionary(words: DataFrame, least: int = LEAST_GRAM, most: int = MOST_GRAM, share: float = FREQUENT,
                    least_frequent: int = FREQUENT_LEAST) -> Dictionary:
    """Level by level the grams that occur more often than ``share`` of all places: 1 / share of them on a level at most."""
    ready(words.sparkSession)
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    out: Dictionary = []
    for _ in range(least, most + 1):
        counts = (words.select("word").mapInArrow(_level_counts(out, least), "gram bigint, n bigint").groupBy("gram")
                  .agg(F.sum("n").alias("n")).where(F.col("n") > max(least_frequent, places * share)))
        rows = counts.collect()  # 1 / share rows at most
        hashes = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        out.append((hashes[order], np.array([r["n"] for r in rows], np.int64)[order]))
    return out


# ---- lists ----------------------------------------------------------------------------------------------------------
POSTING = "list bigint, word string, n bigint, lo int, hi int, itself boolean"


def postings(dictionary: Dictionary, least: int = LEAST_GRAM):
    """A row for a word and a list that serves some of its edits: deletions and replacements at places lo to hi (none if hi < lo),
    and, with ``itself``, insertions. The list 0 is of edits that no gram serves."""
    @light
    def run(batches):
        for batch in batches:
            words = Words(batch["word"])
            word, place, length, h, count, cut = decompose(words, dictionary, least)
            order = np.lexsort((place, h, count, word))
            word, place, length, cut = word[order], place[order], length[order], cut[order]
            n_grams = np.bincount(word, minlength=len(words.length))
            first = np.cumsum(n_grams) - n_grams
            size = words.length
            # edits that every gram so far would be hit by: deletions at dlo..dhi, insertions before glo..ghi
            dlo, dhi, glo, ghi = np.zeros(len(size), np.int64), size - 1, np.zeros(len(size), np.int64), size.copy()
            out: dict[str, list] = {k: [] for k in ("list", "row", "lo", "hi", "itself")}

            def post(key, rows, lo, hi, itself, out=out):
                some = (lo <= hi) | itself
                for k, v in zip(out, (key[some], rows[some], lo[some], hi[some], itself[some]), strict=True):
                    out[k].append(v)
            live, rank = np.arange(len(size)), 0
            while len(live):
                live = live[(dlo[live] <= dhi[live]) | (glo[live] <= ghi[live])]
                done = live[n_grams[live] <= rank]
                if len(done):
                    post(np.zeros(len(done), np.uint64), done, dlo[done], dhi[done], glo[done] <= ghi[done])
                    live = live[n_grams[live] > rank]
                g = first[live] + rank
                p, q, flag = place[g], place[g] + length[g], cut[g]
                a, b, c, d, n = dlo[live], dhi[live], glo[live], ghi[live], size[live]
                start, end = words.start[live], words.end[live]
                # edits after the gram share what is up to its end; edits before it what is from its start on
                post(mix(words.spans(start, start + q) ^ mix(length[g].astype(np.uint64), 21), 22), live,
                     np.maximum(a, q), b, np.maximum(c, q) <= np.where(flag, np.minimum(d, n - 1), d))
                post(mix(words.spans(start + p, end) ^ mix(length[g].astype(np.uint64), 23), 24), live,
                     a, np.minimum(b, p - 1), c <= np.minimum(d, p))
                dlo[live], dhi[live] = np.maximum(a, p), np.minimum(b, q - 1)
                glo[live], ghi[live] = np.maximum(c, p + 1), np.minimum(d, np.where(flag, n, q - 1))
                rank += 1
            got = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
            rows = pa.array(got["row"])
            yield pa.RecordBatch.from_pydict({
                "list": pa.array(got["list"].astype(np.uint64).view(np.int64)), "word": words.column.take(rows),
                "n": batch["n"].take(rows), "lo": pa.array(got["lo"].astype(np.int32)),
                "hi": pa.array(got["hi"].astype(np.int32)), "itself": pa.array(got["itself"].astype(bool))})
    return run


class Variants:
    """What posted words are without one of their code points, and themselves: ``row`` the posting, ``place`` the code point left
    out (-1: none), ``hash`` of what is left."""

    def __init__(self, words: Words, lo: np.ndarray, hi: np.ndarray, itself: np.ndarray):
        count = np.maximum(hi - lo + 1, 0)
        own = np.flatnonzero(itself)
        row = np.repeat(np.arange(len(lo)), count)
        place = ranges(lo, count)
        at = words.start[row] + place
        _, down = _powers(int(words.length.max(initial=0)) + 1, _BASE)
        left = words.spans(words.start[row], at) + down[place] * words.spans(at + 1, words.end[row])
        self.words = words
        self.row, self.place = np.concatenate([row, own]), np.concatenate([place, np.full(len(own), -1)])
        self.hash = mix(np.concatenate([left, words.spans(words.start[own], words.end[own])]), 31)
        #: the first of equal code points in a row: leaving out another of them leaves the same
        self.first = np.ones(len(self.row), bool)
        self.first[:len(row)] = (place == 0) | (words.code[at] != words.code[np.maximum(at - 1, 0)])

    def codes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, code points one after the other) of what is left."""
        row, place = self.row[which], self.place[which]
        length = self.words.length[row] - (place >= 0)
        k = ranges(np.zeros(len(which), np.int64), length)
        gap = np.repeat(np.where(place < 0, np.iinfo(np.int64).max, place), length)
        return length, self.words.code[np.repeat(self.words.start[row], length) + k + (k >= gap)]


def _exact_runs(variants: Variants, which: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Run numbers (rising) after a comparison of code points: members of a run that aren't equal to its first get runs of
    their own equals."""
    length, code = variants.codes(which)
    head = np.searchsorted(run, run)
    same = length == length[head]
    ends = np.cumsum(length)
    k = ranges(np.zeros(int(same.sum()), np.int64), length[same])
    own = np.repeat((ends - length)[same], length[same]) + k
    other = np.repeat((ends - length)[head][same], length[same]) + k
    differ = np.flatnonzero(code[own] != code[other])
    same[np.flatnonzero(same)[np.unique(np.searchsorted(np.cumsum(length[same]), differ, side="right"))]] = False
    if same.all():
        return run
    out, names = run.copy(), {}
    for i in np.flatnonzero(~same).tolist():  # hashes that collided: hardly ever
        name = (int(run[i]), code[ends[i] - length[i]:ends[i]].tobytes())
        out[i] = names.setdefault(name, int(run[-1]) + 1 + len(names))
    return out


def _near(table: pa.Table) -> pa.RecordBatch | None:
    """Per posting with near words: word, how many, the n of the one with most occurrences, and that word."""
    words = Words(table["word"])
    n = table["n"].to_numpy().astype(np.int64)
    variants = Variants(words, table["lo"].to_numpy().astype(np.int64), table["hi"].to_numpy().astype(np.int64),
                        table["itself"].to_numpy(zero_copy_only=False))
    lists = mix(table["list"].to_numpy().astype(np.int64).view(np.uint64), 41)
    by_name = np.empty(len(n), np.int64)
    by_name[pc.sort_indices(words.column).to_numpy()] = np.arange(len(n))
    row, place = variants.row, variants.place
    out = []

    def best(which, run):
        """Adds (row, near words, best n, best row) of runs whose members are all near each other."""
        order = np.lexsort((by_name[row[which]], -n[row[which]], run))
        which, run = which[order], run[order]
        head = np.searchsorted(run, run)
        size = np.searchsorted(run, run, side="right") - head
        some = np.flatnonzero(size > 1)
        pick = head[some] + (some == head[some])
        out.append((row[which[some]], size[some] - 1, row[which[pick]]))

    def runs(which, key):
        """(members, run numbers) of keys that occur more than once, compared exactly."""
        order = np.argsort(key, kind="stable")
        which, key = which[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        many = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
        which, run = which[many], run[many]
        if not len(which):
            return which, run
        run = _exact_runs(variants, which, run)
        order = np.argsort(run, kind="stable")
        return which[order], run[order]
    # replaced: the same place left out of words of one length
    which = np.flatnonzero(place >= 0)
    shape = (words.length[row[which]] << 32 | place[which]).astype(np.uint64)
    which, run = runs(which, mix(variants.hash[which] ^ mix(shape, 51), 52) ^ lists[row[which]])
    if len(which):
        best(which, run)
    # inserted or deleted: what is left of the longer word is the shorter one
    which = np.flatnonzero(variants.first)
    which, run = runs(which, variants.hash[which] ^ lists[row[which]])
    if len(which):
        order = np.lexsort((by_name[row[which]], -n[row[which]], place[which] >= 0, run))
        which, run = which[order], run[order]
        head = np.searchsorted(run, run)
        size = np.searchsorted(run, run, side="right") - head
        whole = place[which[head]] < 0  # the run begins with the shorter word
        longer = np.flatnonzero(whole & (place[which] >= 0))
        out.append((row[which[longer]], np.ones(len(longer), np.int64), row[which[head[longer]]]))
        shorter = np.flatnonzero(whole & (np.arange(len(run)) == head) & (size > 1))
        out.append((row[which[shorter]], size[shorter] - 1, row[which[shorter + 1]]))
    if not out:
        return None
    a, many, b = (np.concatenate(x) for x in zip(*out, strict=True))
    if not len(a):
        return None
    # a posting's rows one after the other, the best near word first; Spark adds up the postings of a word
    order = np.lexsort((by_name[b], -n[b], by_name[a]))
    a, many, b = a[order], many[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], by_name[a[1:]] != by_name[a[:-1]]]))
    return pa.RecordBatch.from_pydict({
        "word": words.column.take(pa.array(a[first])), "n_near": pa.array(np.add.reduceat(many, first)),
        "best_n": pa.array(n[b[first]]), "best": words.column.take(pa.array(b[first]))})


@light
def merge(batches):
    """Lists (rows sorted by list) to near words; a list is never cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < MERGE_ROWS:
            continue
        table = pa.Table.from_batches(held)
        lists = table["list"].to_numpy()
        cut = int(np.searchsorted(lists, lists[-1]))  # the last list may go on
        if cut:
            got = _near(table.slice(0, cut))
            if got is not None:
                yield got
        held, size = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if size:
        got = _near(pa.Table.from_batches(held))
        if got is not None:
            yield got


@light
def deal(batches):
    """Postings of a large list, one for each variant, to lists of their own by what is left."""
    for batch in batches:
        words = Words(batch["word"])
        v = Variants(words, batch["lo"].to_numpy().astype(np.int64), batch["hi"].to_numpy().astype(np.int64),
                     batch["itself"].to_numpy(zero_copy_only=False))
        lists = batch["list"].to_numpy().astype(np.int64).view(np.uint64)[v.row]
        rows = pa.array(v.row)
        own = v.place < 0
        yield pa.RecordBatch.from_pydict({
            "list": pa.array((mix(v.hash ^ mix(lists, 61), 62)).view(np.int64)), "word": words.column.take(rows),
            "n": batch["n"].take(rows), "lo": pa.array(np.where(own, 0, v.place).astype(np.int32)),
            "hi": pa.array(v.place.astype(np.int32)), "itself": pa.array(own)})


def near_words(words: DataFrame, hot_list: int = HOT_LIST, least: int = LEAST_GRAM, most: int = MOST_GRAM, share: float = FREQUENT,
               least_frequent: int = FREQUENT_LEAST) -> DataFrame:
    """Of a table (word, n) of distinct words, those with a word one inserted, deleted or replaced code point away: word, n_near
    (how many such), best and best_n (the one with the largest n; the smallest of equals)."""
    spark = words.sparkSession
    ready(spark)
    dictionary = gram_dictionary(words, least, most, share, least_frequent)
    path = new_table_path(spark, "word-lists")
    words.select("word", "n").mapInArrow(postings(dictionary, least), POSTING).write.parquet(path)
    posted = spark.read.schema(POSTING).parquet(path)
    hot = cut_lineage(posted.groupBy("list").count().where((F.col("count") > hot_list) | (F.col("list") == 0)).select("list"))
    if not hot.isEmpty():
        posted = posted.join(hot, "list", "left_anti").unionByName(posted.join(hot, "list", "left_semi").mapInArrow(deal, POSTING))
    merged = posted.repartition(shuffle_partitions(spark), "list").sortWithinPartitions("list").mapInArrow(
        merge, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return merged.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without circles: forms followed to the last, the reach doubling each round."""
    reach = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(reach.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reach = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reach


def variant_groups(words: DataFrame, factor: int = FORM_FACTOR, **index) -> DataFrame:
    """Of a table (word, n) of distinct words: word, form (its near word with the largest n, the smallest of equals, if that n is
    ``factor`` times the word's or more), root (the last form from here on; the word itself without one), n, n_near, form_n."""
    near = near_words(words, **index)
    has = F.col("best_n") >= factor * F.col("n")
    found = cut_lineage(words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(has, F.col("best")).alias("form"),
        F.when(has, F.col("best_n")).alias("form_n")))
    last = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "words")
    count_words(read_table(spark, sf_dir, "documents", "doc_id", "text")).write.parquet(path)
    return variant_groups(spark.read.parquet(path))
