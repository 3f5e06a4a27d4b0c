"""Language identification by compression: the language whose zstandard dictionaries encode a text in the fewest bytes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import where_text

#: Bounds of the training sample: documents of each language, characters of each; languages in all (more is an error).
TRAIN_DOCS, TRAIN_CHARS, MOST_LANGS = 120, 1000, 1000
#: Each language has so many raw-content dictionaries of so many bytes. A match far back costs as much as a short word, so
#: small dictionaries tell short texts apart best; the sum over several is finer than one size in whole bytes.
DICTIONARIES, DICTIONARY_BYTES = 2, 4000
#: Texts are encoded in blocks of so many bytes, so that a long text can't outgrow the dictionary by its own history.
BLOCK_BYTES = 4096
NO_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str | None) -> str:
    """What is encoded: lower-case words of letters (Unicode category L; numerals and marks aren't letters)."""
    return NO_LETTERS.sub(" ", (text or "").lower()).strip()


def learn(docs: DataFrame, allowed: Column | None = None, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, dictionaries: int = DICTIONARIES, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, list[bytes]]:
    """Raw-content dictionaries by language from docs (doc_id, text, lang), where allowed is true and lang isn't null.

    The sample is bounded: train_docs documents of each language, chosen by a hash of doc_id, train_chars characters of
    each. In a second step the sample is read again with what was learned and documents that fit another language are
    left out, so that wrong labels and texts in two languages weigh little.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if allowed is not None:
        rows = rows.filter(allowed)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"{len(counts)} languages, over {MOST_LANGS}")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 2 * train_docs / n))) for k, n in counts.items()))
    sample = rows.filter(draw < share).select("lang", draw.alias("draw"), F.substring("text", 1, train_chars).alias("text")).collect()
    texts: dict[str, list[str]] = defaultdict(list)
    for lang, _, text in sorted(sample, key=lambda r: (r[0], r[1], r[2])):
        if len(texts[lang]) < train_docs and (text := letters(text)):
            texts[lang].append(text)

    def cut(chosen: dict[str, list[str]]) -> dict[str, list[bytes]]:
        out = {}
        for lang, own in chosen.items():
            each = max(200, dictionaries * dictionary_bytes // len(own))
            data = "\n".join(t[:each] for t in own).encode()
            size = min(dictionary_bytes, max(1, len(data) // dictionaries))
            out[lang] = [data[k * size : (k + 1) * size] for k in range(dictionaries)]
        return out

    first = Classifier(cut(texts))
    return cut({k: [t for t in own if first.predict(t)[0] == k] or own for k, own in texts.items()})


class Classifier:
    """dictionaries: as many for each language."""

    def __init__(self, dictionaries: dict[str, list[bytes]], level: int = 5):
        self.langs, self.encoders = sorted(dictionaries), []
        for lang in self.langs:
            own = []
            for data in dictionaries[lang]:
                content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=level)
                own.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            self.encoders.append(own)

    def sizes(self, data: bytes) -> np.ndarray:
        """Bytes of the text encoded with each language's dictionaries."""
        out = np.zeros(len(self.langs), np.int64)
        for a in range(0, len(data), BLOCK_BYTES):
            block = data[a : a + BLOCK_BYTES]
            out += [sum(len(f(block)) for f in own) for own in self.encoders]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin). The margin is by what share the smallest encoding is smaller than the second smallest."""
        text = letters(text)
        if not text or not self.langs:
            return "und", 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        sizes = self.sizes(text.encode())
        second = int(np.partition(sizes, 1)[1])
        return self.langs[int(np.argmin(sizes))], (second - int(sizes.min())) / second


def classify(docs: DataFrame, dictionaries: dict[str, list[bytes]], min_margin: float = 0.004) -> DataFrame:
    """docs' doc_id with lang_pred, score and rejected, by the whole text.

    lang_pred is the language with the smallest encoding (the first by name of equals) or `und` for a null text or one
    without letters. score, 0 to 1, is the margin to the second smallest. rejected: `und`, or a margin below min_margin.
    Every row gives a row, repeated ones too; other columns are ignored; an empty table gives no rows. dictionaries is of
    bounded size (see learn) and goes to every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = Classifier(shared.value).predict
        for batch in batches:
            found = [predict(t if isinstance(t, str) else None) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in found], "score": [float(x[1]) for x in found]})

    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInPandas(run, "doc_id string, lang_pred string, score double")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "lang_pred", "score", ((F.col("lang_pred") == "und") | (F.col("score") < min_margin)).alias("rejected"))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def drop_rejected(docs: DataFrame, dictionaries: dict[str, list[bytes]], min_margin: float = 0.004) -> DataFrame:
    """docs without the rows whose text has no language or one by a margin below min_margin.

    Each row is judged by its own text, whatever its doc_id (null or repeated ones too), in one pass without a shuffle; all
    columns stay as they are; null and empty texts go; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def judge():
        predict = Classifier(shared.value).predict

        def keeps(text: str | None) -> bool:
            lang, margin = predict(text)
            return lang != "und" and margin >= min_margin

        return keeps

    return where_text(docs, judge)
