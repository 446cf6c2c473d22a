"""Text functions over columns."""

from .compression import compressed_size, compression_ratio
from .fasttext import fasttext
from .minhash import bucket, minhash
from .normalize import normalize
from .randoms import samplebyte, uuid4
from .repetition import repetition_signals
from .scrub import scrub, scrub_native
from .tokenize import tokenize
from .tokens import tokens

__all__ = ["bucket", "compressed_size", "compression_ratio", "fasttext", "minhash", "normalize", "repetition_signals", "samplebyte", "scrub", "scrub_native", "tokenize", "tokens", "uuid4"]


def _default_words(text: str) -> list[str]:
    """Tokens of the default pattern, outside the JVM."""
    from ._regex import compiled
    from .tokens import WORD

    return compiled(WORD).findall(text)
