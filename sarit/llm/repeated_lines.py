"""Problem 5: lines repeated across one site's documents.

Method (p5_method, p5_clusters, p5_clean_clusters): numbers, dates and names are masked in each line: digits, names of
months, the site's own name, and the words after a byline's cue. Lines are clustered within their site by
locality-sensitive hashing of five-word shingles of the masked lines: all BANDS bands, candidates verified by a similarity
of SIMILAR or more, linked over bands and members. Clusters that stand in enough documents are repeated.

p5_found follows the plain rule beside it: lines that are the same after normalisation, counted exactly. The method can't
give it: a cluster joins lines that aren't the same, so its document frequency passes limits that none of its lines
passes. p5_clean and the operators of problems 1 and 10 take out the lines of p5_found.

A host counts as its site. Null sources are left out, null texts count among a source's documents and have no lines.
A line that stands twice in a document counts once there, and both places are reported. Repeated rows of one doc_id
count as documents of their own. Lines of fewer than three words with a letter never count.

Nothing is collected per source: counts are aggregated on the map side by (site, line), so a source with a third of all
rows costs no more than others. The set of recurrent lines has at most 50 lines for each line that an average document
of a source has; its keys go to the executors if they are at most MOST_LINES, else they are joined, with equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.llm.batches import bitmap_of, mix64, passes
from sarit.operators.near_dedup import NearDupParams, bucket_pairs, components
from sarit.plans.arrow import map_text, ragged
from sarit.plans.scale import broadcast_if_small, cut, spread, table

#: A line is repeated if it stands in at least LEAST documents of a source and in more than one of ONE_IN.
LEAST, ONE_IN = 5, 50
#: Bands of ROWS minima of shingles: two lines of a similarity of 0.8 share one with a chance of 0.9992.
BANDS, ROWS, SHINGLE, SIMILAR = 7, 2, 5, 0.8
#: Most recurrent lines whose keys are sent to every executor, two of 8 bytes each.
MOST_LINES = 1_000_000
SPACES = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
# Names of months, masked as dates.
MONTHS = frozenset(
    "january february march april may june july august september october november december "
    "जनवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर "
    "वैशाख जेठ असार साउन भदौ असोज कात्तिक मंसिर पुस माघ फागुन चैत "
    "जानेवारी फेब्रुवारी एप्रिल मे जुलै ऑगस्ट सप्टेंबर ऑक्टोबर नोव्हेंबर डिसेंबर "
    "चैत्र वैशाख ज्येष्ठ आषाढ श्रावण भाद्रपद आश्विन कार्तिक मार्गशीर्ष पौष माघ फाल्गुन".split()
)
# Words after which a byline names its author, and how many words are masked there.
CUES, NAMED = frozenset("by author reporter लेखक लेखन लेखिका संवाददाता रिपोर्टर प्रस्तुति वार्ताहर प्रतिनिधी लेखक: लेखन: लेखिका: संवाददाता: रिपोर्टर: प्रस्तुति: वार्ताहर: प्रतिनिधी: author: reporter: by:".split()), 2


def normal_lines(lines: pa.Array) -> pa.Array:
    """Lines without format characters, trimmed, white space and digit runs as one, lower-cased."""
    lines = pc.replace_substring_regex(lines, r"\p{Cf}+", "")
    lines = pc.utf8_trim(pc.replace_substring_regex(lines, SPACES, " "), " ")
    return pc.replace_substring_regex(pc.utf8_lower(lines), r"\p{Nd}+", "0")


def split_lines(texts: list[str | None], use: list[bool]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the lines that count in the texts in use: row, line number, normal form."""
    rows = [i for i, (t, u) in enumerate(zip(texts, use, strict=True)) if t is not None and u]
    empty = np.zeros(0, np.int64)
    if not rows:
        return empty, empty, pa.array([], pa.string())
    split = pc.split_pattern(pa.array([texts[i] for i in rows], pa.string()), "\n")
    sizes = np.asarray(pc.list_value_length(split)).astype(np.int64)
    row = np.repeat(np.array(rows, np.int64), sizes)
    number = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lines = normal_lines(split.flatten())
    counts = np.asarray(pc.count_substring_regex(lines, r"[^ ]*\p{L}[^ ]*")) >= 3
    return row[counts], number[counts], lines.filter(pa.array(counts))


def _seed(site: str) -> int:
    return xxhash.xxh3_64_intdigest(site)


def line_keys(lines: pa.Array, row: np.ndarray, sites: list[str | None]) -> np.ndarray:
    """64-bit key of each line and its site; of the line alone where that is null."""
    seeds = {s: 0 if s is None else _seed(s) for s in set(sites)}
    own = np.array([seeds[s] for s in sites], np.uint64)[row] if len(row) else np.zeros(0, np.uint64)
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, lines.cast(pa.binary()).to_pylist()), np.uint64, len(row)) ^ own).view(np.int64)


def masked_words(lines: pa.Array, row: np.ndarray, sites: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lines, those masked being 0, and the number of words of each line."""
    words = pc.split_pattern(lines, " ")
    flat = words.flatten().dictionary_encode()
    sizes = np.asarray(pc.list_value_length(words)).astype(np.int64)
    vocabulary = flat.dictionary.to_pylist()
    index = np.asarray(flat.indices).astype(np.int64)
    known = np.array([0 if w == "#" or "0" in w or w.strip(".,:;।|()") in MONTHS else _seed(w) for w in vocabulary], np.uint64)
    hashes = known[index]
    line = np.repeat(np.arange(len(sizes)), sizes)
    latin = np.flatnonzero(np.array([w.isascii() and w.strip(".,:;()").isalpha() for w in vocabulary], bool)[index])
    if len(latin):
        names = [frozenset(s.lower().split("_")) if s else frozenset() for s in sites]
        is_name = np.fromiter((vocabulary[index[i]].strip(".,:;()") in names[row[line[i]]] for i in latin), bool, len(latin))
        hashes[latin[is_name]] = 0
    cue = np.flatnonzero(np.array([w in CUES for w in vocabulary], bool)[index])
    for j in range(1, NAMED + 1):
        at = cue[cue + j < len(line)] + j
        hashes[at[line[at] == line[at - j]]] = 0
    return hashes, sizes


def line_shingles(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of masked lines and the line of each; a shorter line is one shingle."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes)) - (np.cumsum(sizes) - sizes)[line]
    out = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            at = np.flatnonzero(place + j < sizes[line])
            out[at] = mix64(out[at] * np.uint64(31) + hashes[at + j] + np.uint64(j + 1))
    whole = (place + SHINGLE <= sizes[line]) | (place == 0)
    return out[whole], line[whole]


def masked_lines(lines: pa.Array, row: np.ndarray, sites: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key of (site, masked line), its bucket in each band (a row of BANDS), shingles, and the line of each shingle."""
    hashes, sizes = masked_words(lines, row, sites)
    values, line = line_shingles(hashes, sizes)
    seeds = np.array([0 if s is None else _seed(s) for s in sites], np.uint64)[row]
    firsts = np.flatnonzero(np.diff(line, prepend=-1))
    with np.errstate(over="ignore"):
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(hashes)) - np.repeat(starts, sizes)
        key = mix64(np.add.reduceat(mix64(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts) ^ seeds)
        minima = [np.minimum.reduceat(mix64(values ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)), firsts) for k in range(BANDS * ROWS)]
        buckets = []
        for b in range(BANDS):
            bucket = mix64(seeds + np.uint64(b))
            for r in range(ROWS):
                bucket = mix64(bucket * np.uint64(31) + minima[b * ROWS + r])
            buckets.append(bucket.view(np.int64))
    return key.view(np.int64), np.stack(buckets, 1), values, line


def with_site(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """documents with the column site: the source, or the site whose host it is. The registry holds each host once."""
    hosts = registry.where("host is not null and site is not null").groupBy(F.col("host").alias("_host")).agg(F.min("site").alias("_site"))
    return documents.join(broadcast_if_small(hosts), documents["source"] == F.col("_host"), "left").withColumn("site", F.coalesce("_site", "source")).drop("_host", "_site")


def _per_row(batch: pa.RecordBatch, row: np.ndarray, columns: list[tuple[str, np.ndarray, pa.DataType, int]]) -> pa.RecordBatch:
    """doc_id, site and list columns (name, values, type, values of each line) of the rows that have lines."""
    firsts = np.flatnonzero(np.diff(row, prepend=-1))
    sizes = np.diff(np.append(firsts, len(row)))
    take = pa.array(row[firsts])
    lists = [ragged(values, sizes * each, kind) for _, values, kind, each in columns]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("site").take(take), *lists], ["doc_id", "site", *(c[0] for c in columns)])


def line_table(documents: DataFrame, alone: bool = False) -> DataFrame:
    """doc_id, site, and of the lines that count the arrays numbers and keys; of the documents with a site, or (alone) of
    those without, whose keys are of the line alone."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sites = batch.column("site").to_pylist()
        row, number, lines = split_lines(batch.column("text").to_pylist(), [(s is None) == alone for s in sites])
        if not len(row):
            return None
        return _per_row(batch, row, [("numbers", number.astype(np.int32), pa.int32(), 1), ("keys", line_keys(lines, row, sites), pa.int64(), 1)])

    return map_text(documents.select("doc_id", "site", "text"), run, "doc_id bigint, site string, numbers array<int>, keys array<bigint>")


def _recurrent(counts: DataFrame, totals: DataFrame) -> DataFrame:
    return counts.where(F.col("n") >= LEAST).join(totals, "site").where(F.col("n") * ONE_IN > F.col("documents"))


def _alone(batches):
    """The keys of the lines alone of rows of (site, key)."""
    for batch in batches:
        seeds = np.array([_seed(s) for s in batch.column("site").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((np.asarray(batch.column("key")).view(np.uint64) ^ seeds).view(np.int64))], ["key"])


class Lines:
    """The lines of a table of documents, computed once, with the recurrent ones found in it."""

    def __init__(self, spark: SparkSession, sf_dir: str, *more: str):
        """more: columns of the documents that flagged() is to keep."""
        self.more = more
        registry = table(spark, sf_dir, "registry", "site", "host")
        self.documents = with_site(spread(table(spark, sf_dir, "documents", "doc_id", "source", "text", *more)), registry)
        self.totals = cut(with_site(table(spark, sf_dir, "documents", "source"), registry).where("site is not null").groupBy("site").agg(F.count("*").alias("documents")))
        self.table = cut(line_table(self.documents))
        counts = self.table.select("site", F.explode(F.array_distinct("keys")).alias("key")).groupBy("site", "key").agg(F.count("*").alias("n"))
        self.hot = cut(_recurrent(counts, self.totals).select("site", "key", "n"))

    def places(self) -> DataFrame:
        """doc_id, line_no of every occurrence of a recurrent line."""
        return self._of(self.table, self.hot.select("key"))

    def _of(self, lines: DataFrame, keys: DataFrame) -> DataFrame:
        every = lines.select("doc_id", F.explode(F.arrays_zip("numbers", "keys")).alias("line")).select("doc_id", F.col("line.numbers").alias("line_no"), F.col("line.keys").alias("key"))
        return every.join(broadcast_if_small(keys), "key", "left_semi").select("doc_id", "line_no")

    def flagged(self) -> tuple[DataFrame, object]:
        """The documents with the column flags, numbers of recurrent lines (null where the second result serves), and
        a broadcast of the sorted recurrent keys, None if they are too many for that. Documents of a null source are told
        the recurrent lines of any source, by the keys of the lines alone."""
        documents = self.documents.select("doc_id", "site", "text", *self.more)
        hot = self.hot.select("site", "key")
        alone = hot.mapInArrow(_alone, "key bigint").distinct()
        if hot.limit(MOST_LINES + 1).count() <= MOST_LINES:
            keys = np.asarray(hot.select("key").unionAll(alone).toArrow().column("key").combine_chunks())  # two for each of MOST_LINES at most
            shared = self.documents.sparkSession.sparkContext.broadcast(np.unique(keys.astype(np.int64)))
            return documents.withColumn("flags", F.lit(None).cast("array<int>")), shared
        of_none = self._of(line_table(self.documents.where("site is null"), alone=True), cut(alone))
        flags = self.places().unionByName(of_none).groupBy("doc_id").agg(F.collect_set("line_no").alias("flags"))  # the lines of one document
        return documents.join(flags, "doc_id", "left"), None


def flagged_numbers(batch: pa.RecordBatch, shared: object) -> list[set[int]]:
    """The numbers of the recurrent lines of each row of a chunk of flagged()."""
    if shared is None:
        return [set(x or ()) for x in batch.column("flags").to_pylist()]
    out: list[set[int]] = [set() for _ in range(batch.num_rows)]
    hot = shared.value
    if len(hot):
        sites = batch.column("site").to_pylist()
        row, number, lines = split_lines(batch.column("text").to_pylist(), [True] * len(sites))
        keys = line_keys(lines, row, sites)
        there = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
        for r, n in zip(row[there].tolist(), number[there].tolist(), strict=True):
            out[r].add(n)
    return out


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: doc_id, line_no."""
    return Lines(spark, sf_dir).places()


class Clusters:
    """Near-same masked lines of each site, clustered by LSH, with the recurrent clusters found among them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        registry = table(spark, sf_dir, "registry", "site", "host")
        self.documents = with_site(spread(table(spark, sf_dir, "documents", "doc_id", "source", "text")), registry)
        totals = cut(with_site(table(spark, sf_dir, "documents", "source"), registry).where("site is not null").groupBy("site").agg(F.count("*").alias("documents")))
        self.table = cut(map_text(self.documents.select("doc_id", "site", "text"), _masked, "doc_id bigint, site string, numbers array<int>, masks array<bigint>, buckets array<bigint>"))
        ends = self.table.select("masks", "buckets").mapInArrow(_bucket_ends, "key bigint, a bigint, b bigint")
        mixed = cut(ends.groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("key"))
        shared = spark.sparkContext.broadcast(bitmap_of(mixed.select(F.col("key").alias("hash"))))
        met = self.table.select("masks", "buckets").mapInArrow(_meeting(shared), "pos bigint, key bigint").distinct()
        keys = cut(met.join(mixed, "key", "left_semi"))
        some = cut(keys.select("pos").distinct())
        shingled = cut(map_text(self.documents.select("site", "text"), _mask_shingles, "pos bigint, shingles array<bigint>").join(broadcast_if_small(some), "pos", "left_semi").dropDuplicates(["pos"]))
        self.class_of = cut(components(bucket_pairs(keys, shingled, NearDupParams(threshold=SIMILAR, shingle=SHINGLE))).withColumnRenamed("pos", "mask"))
        counts = self.table.select("site", F.explode(F.array_distinct("masks")).alias("mask")).groupBy("site", "mask").agg(F.count("*").alias("n"))
        counts = cut(counts.join(broadcast_if_small(self.class_of), "mask", "left").withColumn("class", F.coalesce("class", "mask")))
        sums = counts.groupBy("site", "class").agg(F.sum("n").alias("n"), F.count("*").alias("n_lines"))
        maybe = cut(_recurrent(sums, totals).select("site", "class", "n", "n_lines", "documents"))
        single, several = maybe.where("n_lines = 1"), maybe.where("n_lines > 1")
        masks = cut(counts.join(maybe.select("site", "class"), ["site", "class"], "left_semi").select("mask", "class"))
        self.masks = masks
        # a document may hold several lines of a class: these are counted by document
        held = self._places(masks).select("doc_id", "class").distinct().join(broadcast_if_small(several.select("class")), "class", "left_semi").groupBy("class").agg(F.count("*").alias("m"))
        exact = several.join(held, "class").where((F.col("m") >= LEAST) & (F.col("m") * ONE_IN > F.col("documents"))).select("site", "class", F.col("m").alias("n"), "n_lines")
        self.hot = cut(single.select("site", "class", "n", "n_lines").unionByName(exact))

    def _places(self, masks: DataFrame) -> DataFrame:
        every = self.table.select("doc_id", F.explode(F.arrays_zip("numbers", "masks")).alias("line")).select("doc_id", F.col("line.numbers").alias("line_no"), F.col("line.masks").alias("mask"))
        return every.join(broadcast_if_small(masks), "mask").select("doc_id", "line_no", "class")

    def places(self) -> DataFrame:
        """doc_id, line_no, cluster of every line of a recurrent cluster."""
        hot = self.masks.join(self.hot.select("class"), "class", "left_semi")
        return self._places(cut(hot)).withColumnRenamed("class", "cluster")


def _bucket_ends(batches):
    """key, a, b: the least and the greatest masked line of each bucket in a batch."""
    for batch in batches:
        masks = np.repeat(np.asarray(batch.column("masks").flatten()), BANDS)
        buckets = np.asarray(batch.column("buckets").flatten())
        order = np.lexsort((masks, buckets))
        masks, buckets = masks[order], buckets[order]
        first = np.flatnonzero(np.diff(buckets, prepend=buckets[:1] - 1)) if len(buckets) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(buckets))[: len(first)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(buckets[first]), pa.array(masks[first]), pa.array(masks[last])], ["key", "a", "b"])


def _meeting(shared: object):
    """pos, key of the masked lines and those of their buckets that are in the bitmap, each once in a batch."""

    def run(batches):
        for batch in batches:
            masks = np.repeat(np.asarray(batch.column("masks").flatten()), BANDS)
            buckets = np.asarray(batch.column("buckets").flatten())
            there = np.flatnonzero(passes(shared.value, buckets.view(np.uint64)))
            there = there[np.lexsort((buckets[there], masks[there]))]
            masks, buckets = masks[there], buckets[there]
            new = np.ones(len(there), bool)
            new[1:] = (masks[1:] != masks[:-1]) | (buckets[1:] != buckets[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(masks[new]), pa.array(buckets[new])], ["pos", "key"])

    return run


def _masked(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    sites = batch.column("site").to_pylist()
    row, number, lines = split_lines(batch.column("text").to_pylist(), [s is not None for s in sites])
    if not len(row):
        return None
    key, buckets, _, _ = masked_lines(lines, row, sites)
    return _per_row(batch, row, [("numbers", number.astype(np.int32), pa.int32(), 1), ("masks", key, pa.int64(), 1), ("buckets", buckets.ravel(), pa.int64(), BANDS)])


def _mask_shingles(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    sites = batch.column("site").to_pylist()
    row, _, lines = split_lines(batch.column("text").to_pylist(), [s is not None for s in sites])
    if not len(row):
        return None
    key, _, values, line = masked_lines(lines, row, sites)
    _, at = np.unique(key, return_index=True)
    keep = np.isin(line, at)
    order = np.lexsort((values[keep], line[keep]))
    line, values = line[keep][order], values[keep][order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (values[1:] != values[:-1])
    line, values = line[new], values[new]
    return pa.RecordBatch.from_arrays([pa.array(key[np.sort(at)]), ragged(values.view(np.int64), np.bincount(line, minlength=len(key))[np.sort(at)], pa.int64())], ["pos", "shingles"])


def method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_method: doc_id, line_no, cluster of every line of a recurrent cluster of near-same lines."""
    return Clusters(spark, sf_dir).places()


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_clusters: site, cluster, n_documents, n_lines (different masked lines) of the recurrent clusters."""
    return Clusters(spark, sf_dir).hot.select("site", F.col("class").alias("cluster"), F.col("n").alias("n_documents"), "n_lines")


def _without(batch: pa.RecordBatch, flags: list[set[int]]) -> pa.RecordBatch:
    """doc_id, text without the flagged lines of texts with a site."""
    texts, sites = batch.column("text").to_pylist(), batch.column("site").to_pylist()
    kept = [t if t is None or s is None or not f else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in f) for t, s, f in zip(texts, sites, flags, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], ["doc_id", "text"])


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_clean: doc_id, text without its repeated lines, those of p5_found; null stays null, a text of repeated lines only
    is empty, texts of a null source stay as they are."""
    flagged, shared = Lines(spark, sf_dir).flagged()
    return map_text(flagged, lambda batch: _without(batch, flagged_numbers(batch, shared)), "doc_id bigint, text string")


def cleaned_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_clean_clusters: doc_id, text without the lines of recurrent clusters, in the same cases as p5_clean. Masked keys of
    the recurrent clusters' lines go to the executors, if they are at most MOST_LINES; else numbers are joined by doc_id."""
    found = Clusters(spark, sf_dir)
    masks = cut(found.masks.join(found.hot.select("class"), "class", "left_semi").select("mask"))
    documents = found.documents.select("doc_id", "site", "text")
    if masks.limit(MOST_LINES + 1).count() <= MOST_LINES:
        shared = spark.sparkContext.broadcast(np.unique(np.asarray(masks.toArrow().column("mask").combine_chunks()).astype(np.int64)))  # MOST_LINES at most

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sites = batch.column("site").to_pylist()
            row, number, lines = split_lines(batch.column("text").to_pylist(), [s is not None for s in sites])
            flags: list[set[int]] = [set() for _ in sites]
            if len(row) and len(shared.value):
                key = masked_lines(lines, row, sites)[0]
                there = shared.value[np.minimum(np.searchsorted(shared.value, key), len(shared.value) - 1)] == key
                for r, n in zip(row[there].tolist(), number[there].tolist(), strict=True):
                    flags[r].add(n)
            return _without(batch, flags)

        return map_text(documents, run, "doc_id bigint, text string")
    flags = found.places().groupBy("doc_id").agg(F.collect_set("line_no").alias("flags"))  # the lines of one document
    return map_text(documents.join(flags, "doc_id", "left"), lambda batch: _without(batch, [set(x or ()) for x in batch.column("flags").to_pylist()]), "doc_id bigint, text string")


# The rule of p5_found, for the driver's comparison.
FOUND_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(r.site, source) AS site, text
           FROM documents LEFT JOIN (SELECT host, min(site) AS site FROM registry GROUP BY host) r ON source = r.host),
n AS (SELECT site, count(*) AS documents FROM d WHERE site IS NOT NULL GROUP BY site),
l AS (SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
      FROM d WHERE site IS NOT NULL AND text IS NOT NULL),
k AS (SELECT doc_id, site, line_no, regexp_replace(lower(trim(regexp_replace(regexp_replace(line, '\p{Cf}+', '', 'g'),
      '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), '\p{Nd}+', '0', 'g') AS line FROM l),
q AS (SELECT * FROM k WHERE len(regexp_extract_all(line, '[^ ]*\p{L}[^ ]*')) >= 3),
h AS (SELECT q.site, line FROM q JOIN n ON q.site = n.site GROUP BY q.site, line, documents
      HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) * 50 > documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no FROM q JOIN h USING (site, line)
"""
CLEAN_SQL = f"""
WITH found AS ({FOUND_SQL}), o AS (SELECT doc_id, list(DISTINCT line_no) AS numbers FROM found GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN numbers IS NULL THEN text ELSE
  array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(numbers, i - 1)), chr(10)) END AS text
FROM documents LEFT JOIN o ON documents.doc_id = o.doc_id
"""
