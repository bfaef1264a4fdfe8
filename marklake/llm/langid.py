"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled with texts known to be in it. A text is encoded with each
dictionary, whole, in blocks of 4 KiB: the dictionary that gives the smallest output names the language. Blocks keep the
dictionary in play over all of a long text, whose own beginning would otherwise serve as one. A lead too small in
proportion to the output counts as a rejection (``accepted`` false); the best language is named all the same.

Texts are encoded as lower-case runs of letters with single spaces, since digits, marks and capitals carry no language but
cost bytes. To the bits of a text come those of its label, -log2 of its share of the labelled rows: they decide where a
text is too short or too uniform for the dictionaries to differ.

Fitting counts all labelled rows, and fills the dictionaries from a bounded sample: for each language the texts of least
hash in each of ``pieces`` hash classes of the labelled rows (every row has its chance, none is taken for its place), and of
each a stretch of ``stretch`` characters from a place given by its hash. The classes are minima, so a language that holds
nearly all rows shrinks before the shuffle. The dictionaries, at most ``MOST_LANGUAGES * pieces * stretch`` characters, go
through the driver to the tasks.

Fixed results: a null text and one without a letter are ``und`` with score 0; so is everything when nothing was learned;
rows with a null label or without a letter teach nothing; ties go to the label that comes first by code point; repeated
rows count again but fill the dictionaries once, and are judged each; a null key is kept; an empty table gives an empty
table; very long texts are encoded whole, block by block; columns other than those named are ignored, so clashing names do
no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

PIECES, STRETCH, MOST_LANGUAGES = 32, 512, 200
BLOCK = 4096
LEVEL = 6
MARGIN = 0.02
UNDECIDED = "und"
LETTER = "\\p{L}"


@dataclass(frozen=True)
class Languages:
    """What was learned: labels in order of code points, their dictionaries' content and their labelled rows."""

    names: tuple[str, ...]
    contents: tuple[bytes, ...]
    rows: tuple[int, ...]


def plain(text: Column) -> Column:
    """Lower-case runs of letters between single spaces."""
    return F.lower(F.concat(F.lit(" "), F.regexp_replace(text, "\\P{L}+", " "), F.lit(" ")))


def fit(labelled: DataFrame, label: str = "lang", text: str = "text", pieces: int = PIECES, stretch: int = STRETCH) -> Languages:
    """Learn from all rows with a label and a letter."""
    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").rlike(LETTER))
    hashed = F.xxhash64("text")
    spare = F.greatest(F.length("text") - stretch, F.lit(0))
    piece = F.substring("text", (F.pmod(F.xxhash64(F.lit(1), "text"), spare + 1) + 1).cast("int"), F.lit(stretch))
    found = F.struct(hashed.alias("hash"), piece.alias("piece"))
    sample = rows.groupBy("label", F.pmod(hashed, F.lit(pieces)).alias("class")).agg(F.min(found).alias("found"), F.count("*").alias("n"))
    taken = sample.limit(MOST_LANGUAGES * pieces + 1).select("label", "found.hash", plain(F.col("found.piece")).alias("piece"), "n").collect()
    names = sorted({row["label"] for row in taken})
    if len(taken) > MOST_LANGUAGES * pieces or len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    of = {name: sorted((row["hash"], row["piece"], row["n"]) for row in taken if row["label"] == name) for name in names}
    return Languages(tuple(names), tuple("".join(p for _, p, _ in of[x]).encode() for x in names), tuple(sum(n for *_, n in of[x]) for x in names))


class Classifier:
    """Encoders of all languages, one for each process."""

    def __init__(self, learned: Languages, level: int = LEVEL) -> None:
        import zstandard as zstd

        self.names, total = learned.names, sum(learned.rows)
        self.label_bits = [math.log2(total / n) for n in learned.rows]
        self.encoders = []
        params = zstd.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        for content in learned.contents:
            held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            self.encoders.append(zstd.ZstdCompressor(dict_data=held, compression_params=params))

    def sizes(self, text: bytes) -> list[int]:
        """Bytes of the whole text under each dictionary."""
        view = memoryview(text)
        blocks = [view[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
        return [sum([len(e.compress(b)) for b in blocks]) for e in self.encoders]

    def judge(self, text: bytes, margin: float) -> tuple[str, float, float, bool]:
        """Label, score, lead over the second in proportion to its output, and whether that lead is wide enough.

        The score reads code lengths as probabilities: the best label's share of 2^-bits, summed over all labels.
        """
        if not self.names:
            return UNDECIDED, 0.0, 0.0, False
        bits = [8 * n + b for n, b in zip(self.sizes(text), self.label_bits, strict=True)]
        best = min(bits)
        share = 1.0 / sum(2.0 ** max(best - b, -1000.0) for b in bits)
        others = sorted(bits)[1:]
        lead = (others[0] - best) / others[0] if others else 1.0
        return self.names[bits.index(best)], share, lead, lead >= margin


def identify(docs: DataFrame, learned: Languages, key: str = "doc_id", text: str = "text", margin: float = MARGIN, level: int = LEVEL) -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (0 to 1), ``lead`` and ``accepted`` of every row."""
    rows = docs.select(F.col(key).alias("key"), F.when(F.col(text).rlike(LETTER), plain(F.col(text))).alias("text"))
    kind = rows.schema["key"].dataType
    schema = StructType(
        [StructField("key", kind), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lead", DoubleType()), StructField("accepted", BooleanType())]
    )
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = None
        for batch in batches:
            classifier = classifier or Classifier(learned, level)
            texts = batch.column(1).cast(pa.large_binary())
            found = [classifier.judge(t.as_buffer(), margin) if t.is_valid else (UNDECIDED, 0.0, 0.0, False) for t in texts]
            columns = [pa.array([f[c] for f in found], type=k) for c, k in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
