"""Tokenizer files: read once on the driver, sent to the tasks as text (a few MB, whatever the data)."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import SparkSession

_here: dict[str, object] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenizerFile:
    """A ``tokenizers`` JSON file that tasks can open wherever they run."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            content = f.read()
        self.version = hashlib.sha256(content.encode()).hexdigest()
        self._content = spark.sparkContext.broadcast(content)

    def spec(self) -> dict:
        return json.loads(self._content.value)

    def open(self):
        """The library's tokenizer, one per Python worker, without truncation and padding."""
        if self.version not in _here:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(self._content.value)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _here[self.version] = tokenizer
        return _here[self.version]


def special_strings(spec: dict) -> dict[str, int]:
    """Added tokens that the library finds in raw text."""
    for token in spec["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token {token['content']!r} has settings this encoder does not know")
    return {token["content"]: token["id"] for token in spec["added_tokens"]}
