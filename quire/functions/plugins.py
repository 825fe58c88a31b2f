"""Handlers that a caller adds for commands and environments that nothing else reads."""

from __future__ import annotations

from quire.functions.parser import Node


class PluginError(Exception):
    """What a plugin can't do; `plugin` names it."""

    def __init__(self, plugin: str, message: str):
        super().__init__(f"{plugin}: {message}")
        self.plugin = plugin


class Plugin:
    """`command` and `environment` return a node, or None to leave it to the next plugin; `transform` gets the whole tree when it is read.

    `on_load` is called once, where a job is declared, before any document is read: it checks what the plugin needs.
    """

    def on_load(self) -> None:
        pass

    def transform(self, nodes: list[Node]) -> list[Node]:
        return nodes

    def command(self, name: str, args: list[str]) -> Node | None:
        return None

    def environment(self, name: str, body: str) -> Node | None:
        return None


class CustomFormat(Plugin):
    """`\\custombold`, `\\customitalic` and `\\customunderline` as their common forms, by prefix."""

    def __init__(self, prefix: str = "custom"):
        self.forms = {prefix + k: v for k, v in (("bold", "textbf"), ("italic", "textit"), ("underline", "underline"))}

    def command(self, name: str, args: list[str]) -> Node | None:
        return Node("Command", name=self.forms[name], args=args[:1]) if name in self.forms and args else None


class Today(Plugin):
    """A date that the caller gives."""

    def __init__(self, text: str, name: str = "currentdate"):
        self.text, self.name = text, name

    def command(self, name: str, args: list[str]) -> Node | None:
        return Node("Text", text=self.text) if name == self.name else None


class Url(Plugin):
    """`\\weblink{u}` and `\\weblink{u}{t}`."""

    def command(self, name: str, args: list[str]) -> Node | None:
        if name != "weblink" or not args:
            return None
        return Node("Command", name="href" if len(args) > 1 else "url", args=args[:2])
