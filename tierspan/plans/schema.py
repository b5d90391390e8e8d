"""Tables of a corpus and the relations between them. Times are whole milliseconds; missing ids are null."""

from __future__ import annotations

from pyspark.sql import types as T

from tierspan.plans.query import Entity

_B, _L, _S, _H = T.BinaryType(), T.LongType(), T.StringType(), T.ShortType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_SEGMENT = (("audio_id", _B), ("start", _L), ("end", _L), ("identifier", _B), ("speaker_id", _B), ("overlap_code", _H), ("label", _S))
_CHILD = (("parent_id", _B), ("parent_start", _L))
_DEEP = (*_CHILD, ("phrase_id", _B), ("phrase_start", _L))
SCHEMAS = {
    "audios": _struct(("identifier", _B), ("filename", _S), ("duration", _L), ("sample_rate", _L), ("n_channels", _H), ("dialect", _S), ("language", _S), ("dataset", _S)),
    "speakers": _struct(("identifier", _B), ("name", _S), ("dataset", _S), ("gender_code", _H), ("age", _H), ("dialect", _S), ("region", _S), ("language", _S)),
    "phrases": _struct(*_SEGMENT, ("filename", _S)),
    "words": _struct(*_SEGMENT, *_CHILD, ("ipa", _S)),
    "syllables": _struct(*_SEGMENT, *_DEEP, ("stress_code", _H)),
    "phones": _struct(*_SEGMENT, *_DEEP, ("position_code", _H)),
    "speaker_audio": _struct(("speaker_id", _B), ("audio_id", _B)),
    # what was imported, and from where: one row a recording
    "imports": _struct(("audio_id", _B), ("source", _S), ("size", _L), ("signature", _S)),
}
#: Tables that aren't objects of a corpus.
LEDGERS = ("imports",)
#: Stored codes and their meaning.
GENDERS = {1: "female", 2: "male", 9: None}
OVERLAPS = {0: False, 1: True, 9: None}
STRESSES = {0: "unstressed", 1: "primary", 2: "secondary"}
POSITIONS = {1: "onset", 2: "nucleus", 3: "coda"}

SEGMENT_ORDER = ("audio_id", "start", "identifier")


def _decoded(code: str, names: dict, default: str | None = None) -> str:
    """SQL for the meaning of a stored code."""
    cases = " ".join(f"WHEN {key} THEN {str(name).lower() if isinstance(name, bool) else repr(name)}" for key, name in names.items() if name is not None)
    return f"CASE {code} {cases} ELSE {'NULL' if default is None else repr(default)} END"


#: Attributes of every segment. `overlap` is what is stored: null where that wasn't decided.
_TIMES = {"duration": "`end` - start", "start_seconds": "start / 1000", "end_seconds": "`end` / 1000", "middle": "(start + `end`) / 2", "overlap": _decoded("overlap_code", OVERLAPS)}
LEVELS = ("phrases", "words", "syllables", "phones")
_UP = {"audio": ("audios", "audio_id"), "speaker": ("speakers", "speaker_id")}
GRAPH = {
    "audios": Entity("identifier", ("identifier",), {}, {name: (name, "audio_id") for name in (*LEVELS, "speaker_audio")}),
    "speakers": Entity("identifier", ("identifier",), {}, {name: (name, "speaker_id") for name in (*LEVELS, "speaker_audio")}, derived={"gender": _decoded("gender_code", GENDERS)}),
    "speaker_audio": Entity("speaker_id", ("speaker_id", "audio_id"), _UP),
    "phrases": Entity("identifier", SEGMENT_ORDER, _UP, {"words": ("words", "parent_id"), "syllables": ("syllables", "phrase_id"), "phones": ("phones", "phrase_id")}, frozenset({"words"}), _TIMES),
    "words": Entity("identifier", SEGMENT_ORDER, _UP | {"phrase": ("phrases", "parent_id"), "parent": ("phrases", "parent_id")}, {"syllables": ("syllables", "parent_id")}, frozenset({"syllables"}), _TIMES),
    "syllables": Entity("identifier", SEGMENT_ORDER, _UP | {"word": ("words", "parent_id"), "parent": ("words", "parent_id"), "phrase": ("phrases", "phrase_id")}, {"phones": ("phones", "parent_id")}, frozenset({"phones"}), _TIMES | {"stress": _decoded("stress_code", STRESSES, "unknown")}),
    "phones": Entity("identifier", SEGMENT_ORDER, _UP | {"syllable": ("syllables", "parent_id"), "parent": ("syllables", "parent_id"), "phrase": ("phrases", "phrase_id")}, derived=_TIMES | {"position": _decoded("position_code", POSITIONS)}, carried={"stress": ("syllable__stress", "unknown")}),
}
