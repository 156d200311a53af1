"""A tagger that asks a language model about a file: its path, imports, symbols and first lines."""

from __future__ import annotations

from dataclasses import dataclass

from ..config import DESIGN_PATTERNS, FRAMEWORKS, PURPOSES
from ..functions.imports import python_modules
from .chunks import symbols
from .embed import HttpEmbedder

#: Suffixes whose symbols are told to the model.
KNOWN = {"py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "cs": "csharp"}


def bullets(items: list[str]) -> str:
    return "\n".join(f"* {x}" for x in items) or "(none)"


def prompt_for(path: str, preview: str, framework: tuple[str, ...] = FRAMEWORKS, design_pattern: tuple[str, ...] = DESIGN_PATTERNS) -> str:
    """The question: which of the known tags fit the file. The answer is to be a JSON object with a list ``tags``."""
    language = KNOWN.get(path.rsplit(".", 1)[-1].lower())
    modules = python_modules(preview) if language == "python" else []
    names = [s.name for s in symbols(preview, path, language, "")] if language else []
    allowed = [f"{kind}:{value}" for kind, values in (("framework", framework), ("design_pattern", design_pattern), ("purpose", PURPOSES)) for value in values]
    return (
        f"Which of these tags describe the source file below?\n{bullets(allowed)}\n\nPath: {path}\nImported modules:\n{bullets(modules)}\nDefined names:\n{bullets(names)}\nFirst lines:\n{preview}\n\n"
        'Reply with one JSON object and nothing else, such as {"tags": ["purpose:util"]}.'
    )


@dataclass(frozen=True)
class HttpTagger:
    client: HttpEmbedder
    model: str
    framework: tuple[str, ...] = FRAMEWORKS
    design_pattern: tuple[str, ...] = DESIGN_PATTERNS

    def __call__(self, path: str, preview: str) -> str:
        return self.client.generate(prompt_for(path, preview, self.framework, self.design_pattern), self.model)
