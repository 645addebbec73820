"""Infrastructure definitions as resources: Terraform, Kubernetes manifests and Dockerfiles.

Anything that isn't a literal becomes {"__unresolved__": true}; a file that can't be read gives a reason, not an error.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNRESOLVED = {"__unresolved__": True}
_TOKEN = re.compile(r'\s+|(?:\#|//)[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|<<-?\w+|[A-Za-z_][\w-]*|-?\d+(?:\.\d+)?|[{}\[\]=,:()?.]|[^\s]', re.S)


class _Hcl:
    def __init__(self, text: str):
        self.t = [x for m in _TOKEN.finditer(text) if not re.match(r"\s|#|//|/\*", x := m[0])]
        self.i = 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k] if self.i + k < len(self.t) else ""

    def take(self) -> str:
        self.i += 1
        return self.t[self.i - 1]

    def body(self, end: str) -> dict:
        out: dict = {}
        while self.peek() != end:
            if not self.peek():
                raise ValueError("unbalanced block")
            name = self.take().strip('"')
            if self.peek() in ("=", ":"):
                self.take()
                out[name] = self.value()
                if self.peek() == ",":
                    self.take()
                continue
            while self.peek() and self.peek() != "{":
                self.take()
            self.take()
            block = self.body("}")
            self.take()
            out[name] = block if name not in out else [*(out[name] if isinstance(out[name], list) else [out[name]]), block]
        return out

    def value(self):
        """A literal, or unresolved for whatever else stands up to the end of the expression."""
        x = self.peek()
        simple = None
        if x == "[":
            self.take()
            items = []
            while self.peek() != "]":
                items.append(self.value())
                if self.peek() == ",":
                    self.take()
                elif self.peek() != "]":
                    raise ValueError("list")
            self.take()
            return items
        if x == "{":
            self.take()
            out = self.body("}")
            self.take()
            return out
        if x.startswith('"') and "${" not in x:
            simple = json.loads(x.replace("\n", "\\n"))
        elif x in ("true", "false"):
            simple = x == "true"
        elif x == "null":
            self.take()
            return None
        elif re.fullmatch(r"-?\d+(?:\.\d+)?", x):
            simple = json.loads(x)
        following = self.peek(1)
        self.take()
        if following in (".", "?", "(", "[") or simple is None:
            while self.peek() in (".", "(", "[") or self.peek(-1) == ".":
                x = self.take()
                if x in ("(", "["):
                    depth = 1
                    while depth and self.peek():
                        y = self.take()
                        depth += (y in "([{") - (y in ")]}")
            return UNRESOLVED
        return simple


def terraform(text: str, path: str) -> list[tuple]:
    out = []
    h = _Hcl(text)
    while h.peek():
        kind = h.take()
        labels = []
        while h.peek() and h.peek() != "{":
            labels.append(h.take().strip('"'))
        if not h.peek():
            break
        h.take()
        body = h.body("}")
        h.take()
        if kind == "resource" and len(labels) == 2:
            out.append((labels[0], labels[1], ".".join(labels), json.dumps(body)))
    return out


def kubernetes(text: str, path: str) -> list[tuple]:
    import yaml

    class Loader(yaml.SafeLoader):
        """Values with tags of applications are unresolved; the rest of the file is read."""

    Loader.add_multi_constructor("!", lambda loader, tag, node: UNRESOLVED)
    out = []
    for doc in yaml.load_all(text, Loader):
        if isinstance(doc, dict) and "kind" in doc and "apiVersion" in doc:
            name = (doc.get("metadata") or {}).get("name") or "unnamed"
            out.append((str(doc["kind"]), str(name), f"{doc['kind']}/{name}", json.dumps(doc, default=lambda _: UNRESOLVED)))
    return out


# What stands in the name of a variable that holds a secret.
SECRET_NAMES = ("password", "passwd", "secret", "api_key", "apikey", "token", "access_key", "private_key")


def _secret(name: str, value: str) -> bool:
    """A secret's name with a literal value, not an empty one or a reference."""
    value = value.strip().strip("\"'")
    return any(x in name.lower() for x in SECRET_NAMES) and value != "" and not value.startswith("$")


def dockerfile(text: str, path: str) -> list[tuple]:
    lines = re.sub(r"\\[ \t]*\n", " ", "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("#"))).splitlines()
    stages: list[dict] = []
    names: set[str] = set()
    for line in lines:
        m = re.match(r"\s*([A-Za-z]+)\s+(.*)", line)
        if not m:
            continue
        op, rest = m[1].upper(), m[2].strip()
        if op == "FROM":
            words = [w for w in rest.split() if not w.startswith("--")]
            image = words[0]
            last = image.rsplit("/", 1)[-1]
            floating = "@" not in image and image not in names and image != "scratch" and "$" not in image and (":" not in last or last.endswith(":latest"))
            stages.append({"base_image": image, "base_image_floating": floating, "user": None, "adds_remote_url": False, "curl_pipe_shell": False, "secret_in_env": False})
            if len(words) >= 3 and words[1].lower() == "as":
                names.add(words[2])
        elif stages:
            s = stages[-1]
            if op == "USER":
                s["user"] = rest.split(":")[0]
            elif op == "ADD":
                s["adds_remote_url"] |= bool(re.search(r"(?:^|\s|\")https?://", rest))
            elif op == "RUN":
                s["curl_pipe_shell"] |= bool(re.search(r"\b(?:curl|wget)\b[^|;&]*\|\s*(?:sudo\s+)?(?:ba|z|da)?sh\b", rest))
            elif op in ("ENV", "ARG"):
                pairs = re.findall(r"([A-Za-z_]\w*)=(\"[^\"]*\"|\S+)", rest) or [tuple((rest.split(None, 1) + [""])[:2])]
                s["secret_in_env"] |= any(_secret(k, v) for k, v in pairs)
    out = []
    for i, s in enumerate(stages):
        user = s.pop("user")
        attrs = s | {"is_final_stage": i == len(stages) - 1, "effective_user_root": user in (None, "root", "0")}
        out.append(("dockerfile_stage", str(i), f"{path}#stage{i}", json.dumps(attrs)))
    return out


RESULT = T.StructType([T.StructField("resources", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "address", "attributes")]))), T.StructField("reason", T.StringType())])
MOST = 16 * 1024 * 1024


def parser_of(path: str):
    name = path.rsplit("/", 1)[-1]
    if name.endswith(".tf"):
        return terraform
    if name.endswith((".yaml", ".yml")):
        return kubernetes
    return dockerfile if name == "Dockerfile" or name.startswith("Dockerfile.") or name.endswith(".Dockerfile") else None


def parse(path: str, text: str) -> tuple[list, str | None]:
    f = parser_of(path)
    if f is None:
        return [], None
    try:
        return f(text, path), None
    except Exception as e:  # a file that can't be read degrades the scan, it doesn't end it
        return [], f"{path}: {type(e).__name__}"


@F.udf(RESULT, useArrow=True)
def parse_udf(path, text):
    return parse(path, text or "")


def resources(files: DataFrame) -> DataFrame:
    """(path, kind, name, address, attributes) of all definitions. files: path, text."""
    mine = F.col("path").rlike(r"(?:\.tf|\.ya?ml|(?:^|/)Dockerfile(?:\.[^/]*)?|\.Dockerfile)$") & (F.octet_length("text") <= MOST)
    rows = files.where(mine).withColumn("r", parse_udf("path", "text"))
    return rows.select("path", F.explode("r.resources").alias("x")).select("path", "x.*")
