"""Texts for images from the caller's model: each hash is asked for once.

The folder of claims is shared by all executors. Before a task asks for an image it
makes the hash's claim, a file that only one can create; the answer is put beside it by
a rename, and the claim goes. A task that is run again, or another run, finds the answer
and doesn't ask; while another's claim stands it leaves the image alone, and once its
lease is over (its executor was lost) it takes the claim over. So a hash is asked for
again only if who asked for it has vanished before its answer was put down.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Images of a question, and seconds that a claim stands.
BATCH, LEASE = 8, 900.0
CLAIMED = "claimed by another"
Describe = Callable[[list[dict]], list[str]]


@dataclass(frozen=True)
class Claims:
    folder: str
    lease: float = LEASE

    def _place(self, image_hash: str) -> str:
        name = hashlib.sha256(image_hash.encode("utf-8", "surrogatepass")).hexdigest()
        return os.path.join(self.folder, name[:2], name)

    def answer(self, image_hash: str) -> str | None:
        try:
            with open(f"{self._place(image_hash)}.answer") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def take(self, image_hash: str) -> bool:
        """Whether the claim is ours now."""
        place = f"{self._place(image_hash)}.claim"
        os.makedirs(os.path.dirname(place), exist_ok=True)
        for _ in range(2):
            try:
                with os.fdopen(os.open(place, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(str(time.time() + self.lease))
                return True
            except FileExistsError:
                try:
                    if time.time() - os.stat(place).st_mtime < self.lease:
                        return False
                    os.rename(place, f"{place}.{uuid.uuid4().hex}")  # of several who see it end, one moves it away
                except FileNotFoundError:
                    return False  # its owner is done, or another has moved it
        return False

    def put(self, image_hash: str, text: str) -> None:
        place = self._place(image_hash)
        draft = f"{place}.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump(text, f)
        os.replace(draft, f"{place}.answer")
        self.release(image_hash)

    def release(self, image_hash: str) -> None:
        try:
            os.unlink(f"{self._place(image_hash)}.claim")
        except FileNotFoundError:
            pass


def described_images(images: DataFrame, describe: Describe, claims: Claims, batch: int = BATCH) -> DataFrame:
    """image_hash, semantic_text, error of images (image_hash and what the model is to see), each hash once.

    ``describe`` is given at most ``batch`` rows as dicts and returns a text for each. Where
    it fails, its images have the error, are free again, and the others go on; those that
    another has claimed say so.
    """
    columns = images.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []

        def asked() -> pd.DataFrame:
            try:
                texts = [str(t).strip() for t in describe([dict(r) for r in held])]
                if len(texts) != len(held):
                    raise ValueError(f"{len(texts)} texts for {len(held)} images")
                for row, text in zip(held, texts, strict=True):
                    claims.put(row["image_hash"], text)
                out = [(r["image_hash"], t, None) for r, t in zip(held, texts, strict=True)]
            except Exception as e:  # noqa: BLE001  a model may fail in any way
                for row in held:
                    claims.release(row["image_hash"])
                out = [(r["image_hash"], None, f"describe_error: {e}") for r in held]
            held.clear()
            return pd.DataFrame(out, columns=["image_hash", "semantic_text", "error"])

        for pdf in batches:
            known = []
            for row in pdf.to_dict("records"):
                name = row["image_hash"]
                if (text := claims.answer(name)) is None and claims.take(name):
                    if (text := claims.answer(name)) is None:  # not while we took the claim either
                        held.append(row)
                        if len(held) >= batch:
                            yield asked()
                        continue
                    claims.release(name)
                known.append((name, text, None if text is not None else CLAIMED))
            if known:
                yield pd.DataFrame(known, columns=["image_hash", "semantic_text", "error"])
        if held:
            yield asked()

    once = images.where("image_hash is not null").groupBy("image_hash").agg(*(F.any_value(c).alias(c) for c in columns if c != "image_hash"))
    return once.select(columns).mapInPandas(run, "image_hash string, semantic_text string, error string")


def set_image_texts(images: DataFrame, described: DataFrame) -> DataFrame:
    """images with the texts that were found; others, and those that failed, stay as they are."""
    found = described.where("error is null").select("image_hash", F.col("semantic_text").alias("_text"))
    both = images.join(found, "image_hash", "left")
    return both.select(*(F.coalesce("_text", "semantic_text").alias("semantic_text") if c == "semantic_text" else F.col(c) for c in images.columns))
