"""Text steps as ML stages, so that one saved PipelineModel scores raw sentences."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.functions.normalize import normalize_text
from opinaria.functions.stem import stem_text
from opinaria.functions.tokens import remove_words
from opinaria.operators.spelling import spell_check
from opinaria.operators.vectorize import Vectorizer
from opinaria.session import computed


class _CleanerWriter(MLWriter):
    """Metadata, and the dictionary beside it: a saved cleaner needs no other file."""

    def __init__(self, cleaner: ReviewCleaner):
        super().__init__()
        self.cleaner = cleaner

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.cleaner, path, self.sparkSession)
        place = self.cleaner.getOrDefault(self.cleaner.dictionary)
        if place:
            self.sparkSession.read.parquet(place).write.parquet(f"{path}/dictionary")


class _CleanerReader(MLReader):
    def load(self, path: str) -> ReviewCleaner:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        cleaner = ReviewCleaner()
        cleaner._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(cleaner, metadata)
        if cleaner.getOrDefault(cleaner.dictionary):
            cleaner._set(dictionary=f"{path}/dictionary")
        return cleaner


class ReviewCleaner(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Normalise, correct spelling (given a dictionary table, which is stored with the stage), remove stop words, stem."""

    def write(self) -> MLWriter:
        return _CleanerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CleanerReader()

    stopWords = Param(Params._dummy(), "stopWords", "words to remove", TypeConverters.toListString)
    stem = Param(Params._dummy(), "stem", "whether to stem", TypeConverters.toBoolean)
    dictionary = Param(Params._dummy(), "dictionary", "path of a (term, n) table, empty for none", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique row id, used by the spelling join", TypeConverters.toString)

    def __init__(self, inputCol="text", outputCol="clean", stopWords=(), stem=True, dictionary="", idCol="doc_id"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="clean", stopWords=[], stem=True, dictionary="", idCol="doc_id")
        self._set(inputCol=inputCol, outputCol=outputCol, stopWords=list(stopWords), stem=stem,
                  dictionary=dictionary, idCol=idCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        text = normalize_text(F.col(self.getInputCol()))
        path = self.getOrDefault(self.dictionary)
        if path:
            df = spell_check(computed(df, **{out: text}), df.sparkSession.read.parquet(path),
                             id_col=self.getOrDefault(self.idCol), text=out)
            text = F.col(out)
        text = remove_words(text, self.getOrDefault(self.stopWords))
        return computed(df, **{out: stem_text(text) if self.getOrDefault(self.stem) else text})


class TermExtractor(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Text to the array of (skip-)n-grams a vectoriser counts."""

    high = Param(Params._dummy(), "high", "longest n-gram", TypeConverters.toInt)
    skip = Param(Params._dummy(), "skip", "words left out, -1 for plain n-grams", TypeConverters.toInt)

    def __init__(self, inputCol="clean", outputCol="terms", high=1, skip=-1):
        super().__init__()
        self._setDefault(inputCol="clean", outputCol="terms", high=1, skip=-1)
        self._set(inputCol=inputCol, outputCol=outputCol, high=high, skip=skip)

    def _transform(self, df: DataFrame) -> DataFrame:
        skip = self.getOrDefault(self.skip)
        spec = Vectorizer("", high=self.getOrDefault(self.high), skip=None if skip < 0 else skip)
        return computed(df, **{self.getOutputCol(): spec.terms(F.col(self.getInputCol()))})
