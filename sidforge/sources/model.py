"""A fitted quantizer as Parquet tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from sidforge.operators.decoder import decode_projected, fit_decoder
from sidforge.operators.fit import CODEBOOK_SCHEMA
from sidforge.operators.project import LAYER_SCHEMA, fetch_layers, mlp_project
from sidforge.operators.quantize import assign_codes, decode, fetch_levels, recon_loss


class Quantizer(NamedTuple):
    """Codebook, optional projection in front of it and its activation, and the way back."""

    codebook: DataFrame
    layers: DataFrame | None = None
    activation: str = "relu"
    decoder: DataFrame | None = None

    def is_small(self) -> bool:
        """Whether codebook and projection ship whole to every task."""
        small = fetch_levels(self.codebook) is not None
        return small and (self.layers is None or fetch_layers(self.layers) is not None)

    def assign(self, df: DataFrame, vec: str = "embedding", keep: list[str] | None = None) -> DataFrame:
        """Codes of every vector, after the projection if there is one."""
        if self.layers is None:
            return assign_codes(df, self.codebook, vec, keep)
        keep = [c for c in df.columns if c != vec] if keep is None else keep
        latent = mlp_project(df, self.layers, self.activation, vec, "_latent")
        return assign_codes(latent.select(*keep, "_latent"), self.codebook, "_latent", keep)

    def with_decoder(self, df: DataFrame, vec: str = "embedding", ridge: float = 0.0) -> Quantizer:
        """The quantizer with the linear decoder that fits the vectors of ``df`` best."""
        coded = self.assign(df, vec, keep=[vec])
        return self._replace(decoder=fit_decoder(coded, self.codebook, vec, ridge))

    def reconstruct(self, coded: DataFrame, out: str = "reconstruction") -> DataFrame:
        """Add the input vector that codes stand for. Behind a projection that takes a decoder."""
        if self.decoder is not None:
            return decode_projected(coded, self.codebook, self.decoder, out)
        if self.layers is not None:
            raise ValueError("codes of projected vectors need a decoder")
        return decode(coded, self.codebook, out)

    def loss(self, df: DataFrame, vec: str = "embedding", kind: str = "mse") -> DataFrame:
        """Reconstruction loss in the space of the input vectors."""
        return recon_loss(self.reconstruct(self.assign(df, vec, keep=[vec])), vec, "reconstruction", kind)


def save_model(model: Quantizer, path: str) -> None:
    """Write the tables of a quantizer below ``path``."""
    spark = model.codebook.sparkSession
    model.codebook.write.mode("overwrite").parquet(f"{path}/codebook")
    has_layers = model.layers is not None
    layers = model.layers if has_layers else spark.createDataFrame([], LAYER_SCHEMA)
    layers.write.mode("overwrite").parquet(f"{path}/projection")
    has_decoder = model.decoder is not None
    decoder = model.decoder if has_decoder else spark.createDataFrame([], LAYER_SCHEMA)
    decoder.write.mode("overwrite").parquet(f"{path}/decoder")
    params = spark.createDataFrame(
        [(model.activation, has_layers, has_decoder)], "activation string, projected boolean, decoded boolean"
    )
    params.write.mode("overwrite").parquet(f"{path}/params")


def load_model(spark: SparkSession, path: str) -> Quantizer:
    params = spark.read.parquet(f"{path}/params").first()
    layers = spark.read.schema(LAYER_SCHEMA).parquet(f"{path}/projection")
    decoder = spark.read.schema(LAYER_SCHEMA).parquet(f"{path}/decoder") if params.decoded else None
    return Quantizer(
        spark.read.schema(CODEBOOK_SCHEMA).parquet(f"{path}/codebook"),
        layers if params.projected else None,
        params.activation,
        decoder,
    )
