"""Options that the stages share, with their defaults, and how a command line sets them."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    """``candidates`` per query, ``name_boost`` of names over synonyms, ``list_size`` of rankers, ``test_share`` of
    organisations held out, ``threshold`` of an answer, ``tfidf`` and ``embeddings``: whether their distances are features."""

    data_dir: str = "data"
    candidates: int = 100
    name_boost: float = 5.0
    list_size: int = 6
    test_share: float = 0.1
    threshold: float = 0.4
    seed: str = "split"
    tfidf: bool = True
    embeddings: bool = True

    @classmethod
    def parse(cls, arguments: list[str]) -> Options:
        parser = argparse.ArgumentParser()
        for f in fields(cls):
            kind = type(f.default)
            parser.add_argument(f"--{f.name}", default=f.default, type=(lambda x: x.lower() in ("1", "true", "yes")) if kind is bool else kind)
        return cls(**vars(parser.parse_args(arguments)))
