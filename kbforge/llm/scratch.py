"""Lineage cuts of this subpackage: kbforge.scratch."""

from kbforge.scratch import drop_written, mark, shared_dir, written

__all__ = ["drop_written", "mark", "shared_dir", "written"]
