"""Script and language analytics on Spark: DataFrame-to-DataFrame operators."""

from scriptorium.functions.registry import languages, ranges
from scriptorium.operators.detect import circle, corpus_report, detect_drawn, detect_images
from scriptorium.operators.ocr import Pack, Recogniser, drawn_pack, latin_pack, packs_from, read_glyphs, read_text
from scriptorium.operators.text import counts_by_join, counts_by_patterns, detect_languages, error_rate, letter_counts, profile, ranked, result

__version__ = "0.1.0"
__all__ = [
    "Pack", "Recogniser", "circle", "corpus_report", "counts_by_join", "counts_by_patterns", "detect_drawn", "detect_images", "detect_languages", "drawn_pack",
    "error_rate", "languages", "latin_pack", "letter_counts", "packs_from", "profile", "ranges", "ranked", "read_glyphs", "read_text", "result",
]
