"""Tables in the folder that driver and executors share, under the name that the operators use."""

from ..sources.checkpoints import written

__all__ = ["written"]
