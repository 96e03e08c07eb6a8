"""Models, geocoders and name finders as batch connectors. Networks and models are given by the caller; the
defaults are deterministic stand-ins, so plans and tests need neither."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batch = Callable[[list[str]], list[str]]


def echo(prompts: list[str]) -> list[str]:
    """The stand-in model: the last line of a prompt."""
    return [p.rsplit("\n", 1)[-1] for p in prompts]


def generate(df: DataFrame, prompt: str, make: Callable[[], Batch] = lambda: echo, out: str = "output", retries: int = 3, wait_s: float = 0.0, batch: int = 32) -> DataFrame:
    """df with the answers of a model. make() builds a client once a task; it is asked in batches; a batch that fails is tried
    again after growing waits, and gives its error (and no answer) when all tries fail, so one bad batch fails no job."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])

    def run(batches):
        ask = make()
        for b in batches:
            for at in range(0, max(1, len(b)), batch):
                part = b.iloc[at : at + batch].copy()
                got, error = [None] * len(part), None
                for k in range(retries):
                    try:
                        got, error = ask(part[prompt].fillna("").tolist()), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a client raises is the row's error
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(wait_s * (k + 1))
                part[out], part[f"{out}_error"] = got, error
                yield part

    return df.mapInPandas(run, schema)


def geocode(df: DataFrame, cache: DataFrame, name: str = "name", make=None) -> tuple[DataFrame, DataFrame]:
    """Df with the cache's lat, lng; and the rows to add to the cache: names it lacks, asked from make() if given."""
    known = df.join(cache.select(name, "lat", "lng"), name, "left")
    missing = df.select(name).distinct().join(cache.select(name), name, "left_anti")
    if make is None:
        return known, missing

    def run(batches):
        ask = make()
        for b in batches:
            found = ask(b[name].tolist())
            yield pd.DataFrame({name: b[name], "lat": [f[0] for f in found], "lng": [f[1] for f in found]})

    return known, missing.mapInPandas(run, f"{name} string, lat string, lng string")


def places_in(text: Column, names: list[str]) -> Column:
    """Names of a small gazetteer that a text holds as whole words; a model may be put in its place by generate()."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^0-9a-z]+", " "), F.lit(" "))
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(padded, F.concat(F.lit(" "), n, F.lit(" "))))
