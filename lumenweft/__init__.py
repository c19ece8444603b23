"""Spark-native frame and colour analytics.

The names below are the library's surface; each is loaded when it is first used.
"""

from importlib import import_module

_SURFACE = {
    "grade_frames": "operators.packed", "profile_frames": "operators.packed", "pixels_of": "operators.packed", "transfer": "operators.transfer", "resize": "operators.resample",
    "scene_cuts": "operators.scene", "scene_segments": "operators.scene", "compare_runs": "operators.bench", "verdicts": "operators.bench", "report": "operators.bench",
    "dispatch": "operators.protocol", "as_of": "operators.sequence", "within": "operators.sequence",
    "read_frames": "sources.frames", "write_frames": "sources.frames", "count_frames": "sources.frames", "read_results": "sources.results", "write_results": "sources.results",
    "resolve": "sources.results", "system_state": "sources.results", "run": "plans.options", "MediaError": "errors", "ServiceError": "errors",
}
__all__ = sorted(_SURFACE)


def __getattr__(name: str):
    if name in _SURFACE:
        return getattr(import_module(f"{__name__}.{_SURFACE[name]}"), name)
    raise AttributeError(f"module {__name__} has no {name}")
