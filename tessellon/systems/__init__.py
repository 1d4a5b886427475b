"""Grid systems: vectorised geometry and topology in numpy, and Column builders where the arithmetic is closed form."""

from tessellon.systems.base import GridSystem, system, systems  # noqa: F401
