"""Where the dependencies of a project have their sources."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import sysconfig
from collections.abc import Iterator
from typing import NamedTuple, Protocol


class Package(NamedTuple):
    name: str
    version: str
    path: str


class CorpusProvider(Protocol):
    def packages(self, root: str) -> Iterator[Package]:
        """Dependencies of the project at root; none if it isn't of this kind."""
        ...


class CargoProvider:
    """Packages with a source of their own by the package manager's metadata (offline first), and the standard library."""

    def packages(self, root: str) -> Iterator[Package]:
        manifest = os.path.join(root, "Cargo.toml")
        if not os.path.isfile(manifest):
            return
        for extra in (["--offline"], []):
            try:
                said = subprocess.run(["cargo", "metadata", "--format-version", "1", "--manifest-path", manifest, *extra], capture_output=True, check=True, timeout=300)
            except (OSError, subprocess.SubprocessError):
                continue
            for p in json.loads(said.stdout)["packages"]:
                if p.get("source"):
                    yield Package(p["name"], p["version"], os.path.dirname(p["manifest_path"]))
            break
        yield from self.standard()

    def standard(self) -> Iterator[Package]:
        try:
            home = subprocess.run(["rustc", "--print", "sysroot"], capture_output=True, check=True, text=True, timeout=60).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return
        for name in ("core", "alloc", "std"):
            path = os.path.join(home, "lib/rustlib/src/rust/library", name, "src")
            if os.path.isdir(path):
                yield Package(name, os.path.basename(home), path)


class PythonProvider:
    """Python's standard library, and packages beside it."""

    def packages(self, root: str) -> Iterator[Package]:
        if any(os.path.isfile(os.path.join(root, x)) for x in ("pyproject.toml", "setup.py", "requirements.txt")):
            yield Package("python-stdlib", "%d.%d.%d" % sys.version_info[:3], sysconfig.get_path("stdlib"))


PROVIDERS: tuple[CorpusProvider, ...] = (CargoProvider(), PythonProvider())


def packages_of(root: str) -> list[Package]:
    """Of all providers, sorted, each once."""
    return sorted({p for x in PROVIDERS for p in x.packages(root)})
