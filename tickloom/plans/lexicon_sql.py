"""The sample lexicon as SQL literals."""

from tickloom.sources.sample import SAMPLE_LEXICON

LEXICON_VALUES = ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in SAMPLE_LEXICON.items())
