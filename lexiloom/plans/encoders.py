"""Encoder names and the wrapper that combines an encoder with a reduction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from lexiloom.operators.grams import MinHashEncoder, TermCountEncoder, TfIdfEncoder, WordVectorEncoder
from lexiloom.operators.kernels import FisherKernelEncoder, LinearMixtureEncoder, SimilarityEncoder
from lexiloom.operators.lookup import (
    BaseNEncoder, ClassFrequencyEncoder, ContrastEncoder, HashCodeEncoder, LeaveOneOutEncoder, OneHotEncoder,
    PassthroughEncoder, TargetMeanEncoder,
)
from lexiloom.operators.reduce import ReducedEncoder
from lexiloom.operators.topics import GammaPoissonEncoder, LdaEncoder, MixtureEncoder, NmfEncoder

# A factory takes the column arguments and the wrapper's options.
Factory = Callable[[dict, dict], Estimator]
_REGISTRY: dict[str | None, Factory] = {}
# Encoders whose categories can be restricted to prototypes.
PROTOTYPE_ENCODERS = (OneHotEncoder, SimilarityEncoder, FisherKernelEncoder, LinearMixtureEncoder)


def register(name: str | None, factory: Factory) -> None:
    """Add an encoder under a name, or replace one."""
    _REGISTRY[name] = factory


def names() -> list:
    return sorted(_REGISTRY, key=str)


def _plain(cls, **fixed) -> Factory:
    return lambda columns, o: cls(**columns, **fixed)


def _grams(cls, **fixed) -> Factory:
    return lambda columns, o: cls(ngramMin=o["ngram_range"][0], ngramMax=o["ngram_range"][1], **columns, **fixed)


def _topics(cls, **fixed) -> Factory:
    def build(columns, o):
        lo, hi = fixed.get("range", o["ngram_range"])
        rest = {k: v for k, v in fixed.items() if k != "range"}
        return cls(nTopics=o["n_components"] or 10, ngramMin=lo, ngramMax=hi, **columns, **rest)
    return build


def _supervised(cls) -> Factory:
    return lambda columns, o: cls(labelCol=o["label"], task=o["task"], **columns)


def _vectors(columns, o):
    if o["vectors"] is None:
        raise ValueError("pretrained vectors need a (word, vector) table")
    return WordVectorEncoder(vectors=o["vectors"], **columns)


register("OneHotEncoder", _plain(OneHotEncoder))
register("OneHotEncoder-1", _plain(OneHotEncoder, dropLast=True))
register("OneHotEncoderDense", _plain(OneHotEncoder))
register("OneHotEncoderDense-1", _plain(OneHotEncoder, dropLast=True))
register("Categorical", _plain(PassthroughEncoder))
register("Passthrough", _plain(PassthroughEncoder))
register(None, _plain(PassthroughEncoder))
register("SimilarityEncoder", _grams(SimilarityEncoder))
register("NgramNaiveFisherKernel", _grams(FisherKernelEncoder, compare="count", theta="uniform"))
register("AdHocIndependentPDF", _plain(FisherKernelEncoder, compare="presence", theta="frequency"))
register("NgramsCountVectorizer", _grams(TermCountEncoder))
register("NgramsTfIdfVectorizer", _grams(TfIdfEncoder))
register("WordNgramsTfIdfVectorizer", _plain(TfIdfEncoder, analyzer="word", ngramMin=1, ngramMax=1))
register("TargetEncoder", _supervised(TargetMeanEncoder))
register("MDVEncoder", _supervised(ClassFrequencyEncoder))
register("LeaveOneOutEncoder", _supervised(LeaveOneOutEncoder))
register("BackwardDifferenceEncoder", _plain(ContrastEncoder, kind="backward", intercept=True))
register("HelmertEncoder", _plain(ContrastEncoder, kind="helmert", intercept=True))
register("SumEncoder", _plain(ContrastEncoder, kind="sum", intercept=True))
register("PolynomialEncoder", _plain(ContrastEncoder, kind="polynomial", intercept=True))
register("BinaryEncoder", _plain(BaseNEncoder, base=2))
register("BaseNEncoder", _plain(BaseNEncoder, base=2))
register("HashingEncoder", _plain(HashCodeEncoder))
register("NgramsLDA", _topics(LdaEncoder))
register("NMF", _topics(NmfEncoder))
register("WordNMF", _topics(NmfEncoder, analyzer="word", range=(1, 1)))
register("NgramsMultinomialMixture", _topics(MixtureEncoder, maxIter=10, range=(2, 4)))
register("AdHocNgramsMultinomialMixture", _plain(LinearMixtureEncoder))
register("OnlineGammaPoissonFactorization", _topics(GammaPoissonEncoder, rho=0.99, eSteps=10))
register("OnlineGammaPoissonFactorization2", _topics(GammaPoissonEncoder, r=0.3, batchSize=256))
register("OnlineGammaPoissonFactorization3", _topics(GammaPoissonEncoder, r=0.3, batchSize=256, init="k-means"))
register("OnlineGammaPoissonFactorization4", _topics(GammaPoissonEncoder, rho=0.95, batchSize=256, init="k-means"))
register("WordOnlineGammaPoissonFactorization",
         _topics(GammaPoissonEncoder, r=0.3, analyzer="word", range=(1, 1), eSteps=10))
register("OnlineGammaPoissonFactorization_fast",
         _topics(GammaPoissonEncoder, r=0.3, range=(3, 3), maxIter=1, minIter=1, rescale=False))
register("MinHashEncoder", lambda columns, o: MinHashEncoder(
    nComponents=o["n_components"] or 30, ngramMin=o["ngram_range"][0], ngramMax=o["ngram_range"][1], **columns))
register("PretrainedFastText", _vectors)
register("PretrainedFastText_fr", _vectors)
register("PretrainedFastText_hu", _vectors)


def column_encoder(name: str | None, input_col: str, output_col: str, reduction: str | None = None,
                   n_components: int | None = None, ngram_range: Sequence[int] = (2, 4),
                   categories: str | Sequence[str] = "auto", handle_unknown: str = "ignore",
                   task: str | None = None, label: str | None = None,
                   vectors: DataFrame | None = None) -> Estimator:
    """Estimator for one column: encoder by name, optional reduction.

    ``most_frequent`` and ``k-means`` restrict the fitted categories to ``n_components``
    prototypes; the other reductions project the encoder's output.
    """
    if name not in _REGISTRY:
        raise ValueError(f"no encoder is named {name!r}")
    if handle_unknown not in ("error", "ignore"):
        raise ValueError(f"handle_unknown is 'error' or 'ignore', not {handle_unknown!r}")
    if categories != "auto" and list(categories) != sorted(categories):
        raise ValueError("explicit categories must be sorted")
    options = {"ngram_range": tuple(ngram_range), "n_components": n_components, "task": task, "label": label,
               "vectors": vectors}
    columns = {"inputCol": input_col, "outputCol": output_col, "handleUnknown": handle_unknown}
    encoder = _REGISTRY[name](columns, options)
    if isinstance(encoder, PROTOTYPE_ENCODERS):
        if categories != "auto":
            encoder._set(categories=list(categories))
        if reduction in ("most_frequent", "k-means"):
            if reduction == "k-means" and not isinstance(encoder, SimilarityEncoder):
                raise ValueError("k-means prototypes are for the similarity encoder")
            encoder._set(categories=reduction, nPrototypes=n_components)
    elif reduction in ("most_frequent", "k-means"):
        raise ValueError(f"encoder {name} has no categories to restrict")
    return ReducedEncoder(encoder, reduction, n_components)
