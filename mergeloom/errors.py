"""Typed errors. Every error has a kind and the details that name the place."""

from __future__ import annotations


class MergeloomError(ValueError):
    """kind says what is wrong, details where: token index, pack, id, rank or byte offset."""

    def __init__(self, kind: str, **details):
        self.kind, self.details = kind, details
        super().__init__(kind + ("" if not details else ": " + ", ".join(f"{k}={v!r}" for k, v in details.items())))


class RegistryError(MergeloomError):
    """Packs or special tokens break a rule of the registry."""


class FlatModelError(MergeloomError):
    """A flat merge table is not well formed."""


class PackModelError(MergeloomError):
    """A pack-local merge table or the set of them is not well formed."""


class ArtifactError(MergeloomError):
    """Bytes are no artifact, or an artifact's parts contradict each other."""


class EncodeError(MergeloomError):
    """A text can't be encoded."""


class DecodeError(MergeloomError):
    """Token ids can't be decoded; details hold the index of the first bad one."""


class TrainingError(MergeloomError):
    """Settings or corpus don't allow training."""


class CorpusError(MergeloomError):
    """Corpus files can't be read as asked."""


class LanguageModelError(MergeloomError):
    """A language model's settings, parameters or inputs are out of range."""
