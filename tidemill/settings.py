"""Settings of a deployment, read from a mapping such as the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

PROVIDERS = ("openai_compatible",)
#: Words that switch a setting off, and on where off is the default. Fixed values.
OFF, ON = ("0", "false", "no"), ("1", "true", "yes")


@dataclass(frozen=True)
class Provider:
    name: str
    api_key: str
    base_url: str


@dataclass(frozen=True)
class Settings:
    llm_provider: str = "openai_compatible"
    embed_provider: str = "openai_compatible"
    llm_model: str = "glm-4-flash"
    embed_model: str = "embedding-3"
    embed_device: str = "cpu"
    local_embed_normalize: bool = True
    local_embed_trust_remote_code: bool = False
    openai_compat_api_key: str = ""
    openai_compat_base_url: str = ""

    @classmethod
    def read(cls, values: Mapping[str, str] | None = None) -> Settings:
        """Each field from the value by its name in capitals; a switch that is on stays on unless a word of OFF is said, and the other way round."""
        values = os.environ if values is None else values
        out = {}
        for name, field in cls.__dataclass_fields__.items():
            said = values.get(name.upper())
            if said is not None:
                word = said.strip()
                out[name] = word if not isinstance(field.default, bool) else word.lower() not in OFF if field.default else word.lower() in ON
        return cls(**out)

    def provider(self, name: str | None = None) -> Provider:
        """The provider's key and address; an unknown one, or one without them, is an error."""
        name = (name or self.llm_provider).lower()
        if name not in PROVIDERS:
            raise ValueError(f"unsupported provider: {name}")
        if not self.openai_compat_api_key or not self.openai_compat_base_url:
            raise ValueError(f"{name} needs an API key and a base URL")
        return Provider(name, self.openai_compat_api_key, self.openai_compat_base_url)
