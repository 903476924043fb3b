"""What a Python worker keeps from task to task: one thing at a time.

Workers outlive jobs, and an executor's memory holds all of its workers. So what one keeps goes as soon
as another thing is to be kept, and when a task of another operator begins.
"""

from collections.abc import Callable, Hashable
from typing import Any

_held: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The thing of this key; if it is not there, the one before goes and then it is made."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    _held.clear()
