"""Lineage cuts in the folder that driver and executors share."""

from gradewise.sources.shared import materialize, release, shared_folder

__all__ = ["materialize", "release", "shared_folder"]
