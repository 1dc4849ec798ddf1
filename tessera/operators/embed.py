"""Embedding texts: deterministic feature hashing, or an ONNX model where one is at hand.

The hashed vectors are lexical: texts are near if they share words, not if they mean the same.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.spec import BATCH, DIMENSION, SEQUENCE

_WORD = re.compile(r"\w+")


def hashed(texts: list[str | None], dimension: int = DIMENSION) -> np.ndarray:
    """One signed count per word and position, of unit length; zero for texts without words."""
    import xxhash

    out = np.zeros((len(texts), dimension), np.float32)
    for i, t in enumerate(texts):
        for w in _WORD.findall((t or "").lower()):
            h = xxhash.xxh64_intdigest(w)
            out[i, h % dimension] += 1 if h >> 63 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean over tokens, then unit length; all-zero masks and zero vectors give zero."""
    mask = mask.astype(np.float32)[:, :, None]
    mean = (hidden * mask).sum(1) / np.maximum(mask.sum(1), 1e-9)
    norms = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.divide(mean, norms, out=np.zeros_like(mean), where=norms > 0)


class OnnxEmbedder:
    """Tokenizer and model of a folder; loaded once per worker."""

    def __init__(self, folder: str, model: str = "model.onnx") -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # one Python worker per core
        self.session = onnxruntime.InferenceSession(f"{folder}/{model}", options, providers=["CPUExecutionProvider"])
        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.tokenizer.enable_truncation(SEQUENCE)
        self.tokenizer.enable_padding()

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        enc = self.tokenizer.encode_batch([t or "" for t in texts])
        feed = {
            "input_ids": np.array([e.ids for e in enc], np.int64),
            "attention_mask": np.array([e.attention_mask for e in enc], np.int64),
            "token_type_ids": np.array([e.type_ids for e in enc], np.int64),
        }
        names = {i.name for i in self.session.get_inputs()}
        return pooled(self.session.run(None, {k: v for k, v in feed.items() if k in names})[0], feed["attention_mask"])


_loaded: dict[str, OnnxEmbedder] = {}


DEFAULT_MODEL = "minilm-l6-v2"


def resolve_model(model: str | None, model_dir: str | None, data: str) -> str | None:
    """The folder of a model: the one given, else models/<model> here, else in the data folder. None, which stands for
    hashed vectors, only if no model was asked for by name."""
    if model_dir:
        return model_dir
    for folder in (os.path.join("models", model or DEFAULT_MODEL), os.path.join(data, "models", model or DEFAULT_MODEL)):
        if os.path.exists(os.path.join(folder, "tokenizer.json")):
            return folder
    if model:
        raise FileNotFoundError(f"model {model} is neither in ./models nor in {data}/models; give its folder with --model-dir")
    return None


def embedder(model_dir: str | None):
    if model_dir is None:
        return hashed
    if model_dir not in _loaded:
        _loaded[model_dir] = OnnxEmbedder(model_dir)
    return _loaded[model_dir]


def embed(df: DataFrame, text: str = "text", model_dir: str | None = None) -> DataFrame:
    """df with embedding array<float>, made in Arrow batches of at most BATCH texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder(model_dir)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                v = np.asarray(model(b.column(b.schema.get_field_index(text)).to_pylist()), np.float32)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float32()))
                yield b.append_column("embedding", flat)

    df = df.drop("embedding")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, embedding array<float>")


def embed_query(query: str, model_dir: str | None = None) -> list[float]:
    return [float(x) for x in embedder(model_dir)([query])[0]]


