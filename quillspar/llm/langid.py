"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of its own texts. A
text is compressed with every dictionary, block by block so that what it repeats
itself counts little, in lower case as the dictionaries are, and the smallest total names the language. A narrow margin
is a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textops
from .shared import small_batches

#: The sample a dictionary is made of: so many texts of a language, so many bytes of each.
SAMPLE_TEXTS = 64
SAMPLE_BYTES = 1024
LEVEL = 9
BLOCK_BYTES = 4096
#: Bytes that halve the odds of a language against the best.
HALF_ODDS = 2.0
REJECT_BELOW = 0.6
UNKNOWN = "und"

SCHEMA = "doc_id long, lang string, best string, score double, rejected boolean, bytes array<struct<lang:string,bytes:long>>"


@dataclass
class LanguageDictionaries:
    contents: dict[str, bytes]

    def compressors(self) -> list[tuple[str, object]]:
        import zstandard

        out = []
        for lang, content in sorted(self.contents.items()):
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=LEVEL)
            out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_checksum=False, write_content_size=False, write_dict_id=False)))
        return out


def learn(labelled: DataFrame, *, sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES) -> LanguageDictionaries:
    """A dictionary for each lang of ``labelled`` (doc_id, text, lang).

    Rows without lang or text teach nothing. The texts are drawn by a hash of id
    and text, so the draw is the same on every run and for every layout; the
    sample is bounded by its two parameters and drawn without gathering a
    language in one task. Of a longer text the bytes from a hashed offset count, so
    that a shared header is not all that a dictionary holds.
    """
    rows = labelled.where("lang is not null and text is not null and text <> ''").select("lang", "text", F.xxhash64("doc_id", F.octet_length("text")).alias("draw"))
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return LanguageDictionaries({})
    share = F.broadcast(labelled.sparkSession.createDataFrame([(r["lang"], float(2 * sample_texts) / r["count"]) for r in counts], "lang string, share double"))
    unit = (F.col("draw").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    drawn = rows.join(share, "lang").where(unit < F.col("share")).select("lang", "draw", "text")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    texts: dict[str, list[bytes]] = {}
    content = F.encode(F.lower("text"), "UTF-8")
    offset = F.pmod(F.xxhash64("draw"), F.greatest(F.octet_length(content) - sample_bytes, F.lit(0)) + 1).cast("int")
    for row in drawn.withColumn("nth", nth).where(F.col("nth") <= sample_texts).select("lang", content.substr(offset + 1, F.lit(sample_bytes)).alias("text"), "nth").orderBy("lang", "nth").collect():
        piece = bytes(row["text"])
        if piece not in texts.setdefault(row["lang"], []):
            texts[row["lang"]].append(piece)
    return LanguageDictionaries({lang: b"\n".join(found).ljust(8, b" ") for lang, found in texts.items()})


def identify(docs: DataFrame, model: LanguageDictionaries, *, reject_below: float = REJECT_BELOW) -> DataFrame:
    """lang, best, score, rejected and compressed sizes for each row of ``docs`` (doc_id, text).

    ``best`` is the language of the smallest size (ties: the first by name);
    ``lang`` is the same unless the margin is narrow. A null text, one without a
    letter, or a model without languages gives ``und`` with score 0. Repeated
    rows are judged each for itself; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors()
        names = [lang for lang, _ in tools]
        for batch in textops.slices(batches):
            best, score, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                if not tools or not text or not any(map(str.isalpha, text)):
                    best.append(UNKNOWN), score.append(0.0), sizes.append([])
                    continue
                data = text.lower().encode()
                blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
                size = np.array([sum(len(tool.compress(b)) for b in blocks) for _, tool in tools])
                best.append(names[int(size.argmin())])
                score.append(float(1 / np.exp2((size.min() - size) / HALF_ODDS).sum()))
                sizes.append([{"lang": n, "bytes": s} for n, s in zip(names, size.tolist(), strict=True)])
            rejected = [s < reject_below for s in score]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([UNKNOWN if r else b for b, r in zip(best, rejected, strict=True)], pa.string()), pa.array(best, pa.string()),
                    pa.array(score, pa.float64()), pa.array(rejected), pa.array(sizes, pa.list_(pa.struct([("lang", pa.string()), ("bytes", pa.int64())]))),
                ], names=["doc_id", "lang", "best", "score", "rejected", "bytes"],
            )

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
