"""The whole flow over a folder: plan, resolve, apply, undo, watch, discover and doctor."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from . import models as M
from .functions.names import locality
from .functions.vectors import key_of
from .operators import cascade, cluster, naming, rank, rules
from .plans import plan as P
from .plans import questions as Q
from .plans.journal import write_whole
from .runtime import shared_root
from .sources import extract, listing, stores
from .sources.keyed import KeyedStore
from .streaming import watch as W


@dataclass
class Organizer:
    spark: SparkSession
    cfg: C.Config
    backend: M.Backend
    state: str
    config_path: str | None = None
    stages: str = field(default="")
    #: How the items of the last plan were come by: counts by way, and of all.
    via: dict[str, int] = field(default_factory=dict)
    notify: Callable[[str], None] | None = None

    def __post_init__(self) -> None:
        Path(self.state).mkdir(parents=True, exist_ok=True)
        self.stages = f"{shared_root(self.spark)}/organizer-{uuid.uuid4().hex}"

    # Tables

    @property
    def vectors(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.state}/vectors", stores.VECTOR)

    @property
    def verdicts(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.state}/verdicts", stores.VERDICT)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a stage down, so that a model's answers are asked for once."""
        path = f"{self.stages}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def taxonomy(self) -> DataFrame:
        return self.spark.createDataFrame([(i, c.path, c.description) for i, c in enumerate(self.cfg.categories)], "ord int, category string, description string")

    def examples(self) -> DataFrame:
        """Examples of live categories, read anew each time, numbered in order."""
        rows = stores.read_json(self.spark, f"{self.state}/examples.jsonl", stores.EXAMPLE).withColumn("seq", F.monotonically_increasing_id())
        return stores.live(rows, self.taxonomy()).select("seq", "name", "snippet", "category")

    def queue(self) -> DataFrame:
        return stores.read_json(self.spark, f"{self.state}/questions.jsonl", stores.QUESTION)

    def _write_queue(self, rows: list[dict]) -> None:
        write_whole(f"{self.state}/questions.jsonl", "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))

    # Classification

    def embed(self, rows: DataFrame) -> DataFrame:
        """Adds ``vec`` to rows with text; only texts not seen before reach the model."""
        model = self.cfg.strategy.embed_model
        rows = rows.withColumn("_key", key_of(model, F.col("_text")))
        store = self.vectors
        missing = M.missing_texts(rows.select(F.col("_key").alias("key"), F.col("_text").alias("text")), store.read())
        store.put(self.save(M.embed_column(missing, self.backend).select("key", "vec"), "vectors"))
        return store.lookup(rows, "_key").withColumn("vec", F.col("held.vec")).drop("_key", "held")

    def classify(self, entries: DataFrame) -> DataFrame:
        """Plan items of listed entries (path, name, kind, size, mtime, head, tail)."""
        s = cascade.Settings(self.cfg.strategy.mode, self.cfg.strategy.margin, self.cfg.strategy.shortlist, rank.similar_threshold(self.cfg.strategy.embed_model), self.cfg.min_confidence)
        ruled = entries.withColumn("rule", F.when(F.col("kind") == "file", rules.first_rule(F.col("name"), self.cfg.rules)))
        by_rule = cascade.by_rule(ruled)
        vision = M.vision_model(self.cfg, self.backend)
        rest = self.save(extract.previews(ruled.where("rule is null").drop("rule"), vision is not None, self.cfg.max_preview_chars), "previews")

        examples = self.examples()
        print_ = self.cfg.fingerprint(sorted(map(tuple, examples.select("name", "snippet", "category").collect())))
        rest = rest.withColumn("key", stores.verdict_key(print_, F.col("kind"), F.col("name"), F.col("text"), F.col("image")))
        hits, misses = cascade.by_cache(rest, self.verdicts.read())
        misses = misses.withColumn("document", M.document_text(F.col("kind"), F.col("name"), F.col("text")))
        if s.mode != "llm":
            before, of_category = M.prefixes(self.cfg.strategy.embed_model)
            misses = self.embed(misses.withColumn("_text", F.concat(F.lit(before), F.col("document")))).drop("_text")
            cats = self.embed(self.taxonomy().withColumn("_text", F.concat(F.lit(of_category), M.category_text(F.col("category"), F.col("description")))))
            taught = self.embed(examples.withColumn("_text", F.concat(F.lit(before), F.col("name"), F.lit("\n"), F.col("snippet"))))
            misses = rank.ranked(misses, cats, examples=taught, tau=s.tau)
            misses = self.save(rank.nearest(misses, taught, 4), "ranked")

        def choose(rows: DataFrame) -> DataFrame:
            asked = self.save(M.choose_column(M.with_prompts(rows, [(c.path, c.description) for c in self.cfg.categories]), self.backend, vision), "asked")
            return asked.withColumn("picked", cascade.parse_choice(F.col("answer"), F.col("choices")))

        fresh = self.save(cascade.decide(misses, self.cfg.paths, s, choose, self.save), "verdicts")
        if "failed" in fresh.columns:
            bad = F.col("failed").isNotNull()
            error = {"category": F.lit(self.cfg.paths[0]), "confidence": F.lit(0.0), "via": F.lit("error"), "alternatives": F.array().cast("array<string>"), "reason": F.col("failed")}
            fresh = fresh.withColumns({c: F.when(bad, v).otherwise(F.col(c)) for c, v in error.items()})
        self.verdicts.put(fresh.where("via <> 'error'").select("key", "category", "confidence", "alternatives", "reason"))
        items = cascade.finish(cascade.union([by_rule, hits, fresh]), self.cfg.paths[0], self.cfg.min_confidence)
        out = items.select(
            F.col("path").alias("src"), "name", "kind", "category", "confidence", "reason", "via", "alternatives", "review",
            F.substring(F.coalesce("text", F.lit("")), 1, 400).alias("snippet"), F.coalesce("about", F.lit("")).alias("about"),
        )
        counted, seen = P.counted(out)
        items = self.save(counted, "items")
        self.via = {k: n for k, n in seen.get.items() if n}
        return items

    def plan(self, source: str) -> DataFrame:
        """One row per entry of a folder, in its order, with the target each would go to."""
        root = str(Path(source).expanduser().resolve())
        here = root == str(Path(self.cfg.destination).expanduser().resolve())
        entries = listing.scan(self.spark, root, self.cfg.ignore, self.cfg.owned if here else frozenset(), self.cfg.folders_as_units)
        return self.with_targets(self.classify(entries)).orderBy(F.col("kind") == "folder", F.lower("name"))

    def with_targets(self, items: DataFrame) -> DataFrame:
        home = str(Path(self.cfg.destination).expanduser())
        return items.withColumn("target", P.target(F.col("category"), F.col("review"), F.col("name"), home, self.cfg.review_folder, self.cfg.when_unsure))

    # Actions; the plan is as small as a folder

    def apply(self, plan: DataFrame, confirmed: bool = False) -> tuple[int, list[str]]:
        """Moves what has a target, once confirmed, and queues the unsure."""
        if not confirmed:
            raise PermissionError("nothing moves before it is confirmed")
        rows = plan.collect()
        moved = P.apply(rows, f"{self.state}/journal/run-{time.strftime('%Y%m%d-%H%M%S')}.jsonl")
        if self.cfg.when_unsure == "ask":
            self.enqueue(plan.where("review and target is null"))
        return moved

    def save_plan(self, plan: DataFrame, path: str) -> None:
        P.save({"destination": self.cfg.destination, "review_folder": self.cfg.review_folder, "when_unsure": self.cfg.when_unsure, "created": time.time(), "items": [r.asDict(True) for r in plan.collect()]}, path)

    def report(self, plan: DataFrame) -> str:
        """The plan as text, and how many items go where."""
        return P.report([r.asDict(True) for r in plan.collect()])

    def save_proposal(self, proposals: list[dict], path: str) -> None:
        P.save({"created": time.time(), "groups": proposals}, path)

    def apply_saved(self, path: str | None = None, confirmed: bool = False) -> tuple[int, list[str]]:
        """Moves a saved plan, or the latest, and marks it applied; it needs the same confirmation."""
        if not confirmed:
            raise PermissionError("nothing moves before it is confirmed")
        found = Path(path) if path else P.latest_plan(f"{self.state}/plans")
        if found is None:
            raise FileNotFoundError("no plan is saved")
        result = P.apply(json.loads(found.read_text(encoding="utf-8"))["items"], f"{self.state}/journal/run-{time.strftime('%Y%m%d-%H%M%S')}.jsonl")
        found.rename(found.with_suffix(".applied"))
        return result

    def undo(self, last: int | None = None) -> tuple[int, list[str]]:
        journal = P.latest_journal(f"{self.state}/journal")
        return P.undo(journal, last) if journal else (0, [])

    def enqueue(self, items: DataFrame) -> int:
        order = items.withColumn("seq", F.monotonically_increasing_id())
        new = Q.enqueue(self.queue(), order).select("src", "kind", "category", "alternatives", "reason", "snippet", "about").collect()
        now = time.time()
        self._write_queue([r.asDict(True) for r in self.queue().collect()] + [r.asDict(True) | {"dest": self.cfg.destination, "asked": now} for r in new])
        return len(new)

    def pending(self) -> list[dict]:
        """Questions whose file is still there; the others are dropped."""
        rows = [r.asDict(True) for r in self.queue().collect() if Path(r["src"]).exists()]
        self._write_queue(rows)
        return rows

    def answer(self, answers: dict[str, Q.Answer]) -> tuple[int, list[str]]:
        """Files the answered questions where they were going, adds new categories, and learns from each answer."""
        rows, left, todo = self.pending(), [], []
        for r in rows:
            a = answers.get(r["src"])
            if a is None or a.action == "quit":
                left.append(r)
            elif a.action in ("file", "new"):
                if a.action == "new" and a.category not in self.cfg.paths:
                    if self.config_path:
                        C.add_categories(self.config_path, [C.Category(a.category, a.description)])
                    self.cfg.categories.append(C.Category(a.category, a.description))
                stores.add_example(f"{self.state}/examples.jsonl", Path(r["src"]).name, r["snippet"] or "", a.category, self.cfg.paths)
                todo.append({"src": r["src"], "target": str(Path(r["dest"]).expanduser() / a.category / Path(r["src"]).name)})
        self._write_queue(left)
        return P.apply(todo, f"{self.state}/journal/ask-{time.strftime('%Y%m%d-%H%M%S')}.jsonl") if todo else (0, [])

    def teach(self, path: str, category: str) -> None:
        """Adds a file as an example of a category."""
        p = Path(path)
        found = extract.folder(str(p)) if p.is_dir() else extract.parse(extract.File(str(p)), extract.local_sniff(extract.File(str(p))))
        stores.add_example(f"{self.state}/examples.jsonl", p.name, found.text, category, self.cfg.paths)

    def handle_settled(self, batch: DataFrame, number: int = 0) -> list[dict]:
        """One batch of a watch: classifies settled paths and routes them."""
        paths = [r["path"] for r in batch.select("path").collect() if Path(r["path"]).exists()]
        done: list[dict] = []
        for parent in sorted({str(Path(p).parent) for p in paths}):
            entries = listing.scan(self.spark, parent, self.cfg.ignore, self.cfg.owned, True).where(F.col("path").isin([p for p in paths if str(Path(p).parent) == parent]))
            routed = W.route(self.with_targets(self.classify(entries)), self.cfg.when_unsure)
            rows = routed.collect()
            P.apply(rows, f"{self.state}/journal/watch-{time.strftime('%Y%m%d')}.jsonl")
            asked = routed.where("route = 'asked'")
            if any(r["route"] == "asked" for r in rows):
                fresh = self.enqueue(asked)
                if fresh and self.notify and self.cfg.watch.notify:
                    self.notify(f"{fresh} file{'' if fresh == 1 else 's'} with an open question")
            done += [{"src": r["src"], "route": r["route"], "category": r["category"]} for r in rows]
        return done

    def watch(self, folders: list[str], include_existing: bool = False, once: bool = False):  # noqa: ANN201
        # A watch that is taken up again knows from its state what it has handled.
        new = not include_existing and not Path(self.watch_state(folders)).exists()
        existing = self.save(W.present(self.spark, folders, self.cfg.ignore, self.cfg.owned), "existing") if new else None
        looks = W.observe(self.spark, folders, self.cfg.ignore, self.cfg.owned)
        return W.start(looks, self.handle_settled, self.watch_state(folders), self.cfg.watch.settle_seconds, self.cfg.watch.interval, existing, once)

    def watch_state(self, folders: list[str]) -> str:
        """Where a watch of these folders keeps its state, so that it is taken up again after a restart."""
        return f"{self.state}/watch-{hashlib.sha256(json.dumps(sorted(folders)).encode()).hexdigest()[:12]}"

    def sweep(self, folders: list[str]) -> list[dict]:
        """Handles everything there is now, except what changed within the settle time."""
        ready: list[str] = []
        for f in folders:
            ready += [r["path"] for r in W.sweep(listing.scan(self.spark, f, self.cfg.ignore, self.cfg.owned), F.current_timestamp(), self.cfg.watch.settle_seconds).where("ready").collect()]
        return self.handle_settled(self.spark.createDataFrame([(p,) for p in ready], "path string")) if ready else []

    def discover(self, root: str, limit: int = 300, fresh: bool = False) -> list[dict]:
        """Proposed categories: path, description, existing, members (most central first); and what was left ungrouped."""
        files = self.save(extract.previews(listing.gather(self.spark, root, self.cfg.ignore, limit), False, 800), "gathered")
        before, _ = M.prefixes(self.cfg.strategy.embed_model)
        rows = self.embed(files.withColumn("_text", F.concat(F.lit(before + "File: "), F.col("name"), F.lit("\n"), F.col("text"))))
        rows = self.save(rows.select("path", "name", "text", "vec"), "vectors")
        labelled = self.save(rows.join(cluster.over_split(rows, "path"), "path"), "clusters")
        central = self.save(cluster.central(labelled, "path", limit).join(labelled.select("path", "name", "text"), "path"), "central")
        taxonomy = self.taxonomy() if not fresh else self.taxonomy().limit(0)
        groups = self.save(naming.named(central, taxonomy, self.backend), "named")
        merged = cluster.merge_named(groups.select("cluster", "path", "members")).where("path is not null")
        # Of groups with one path, the largest speaks for them.
        first = groups.where("path is not null").groupBy("path").agg(F.min_by(F.struct("description", "existing"), F.struct(-F.col("n"), "cluster")).alias("a"))
        found = merged.join(first, "path").select("path", "members", "a.*").orderBy(F.desc(F.size("members")), "path")
        out = [{"path": r["path"], "members": r["members"], "existing": r["existing"], "description": r["description"]} for r in found.collect()]
        kept = found.select(F.explode("members").alias("path"))
        loose = [r["path"] for r in central.join(kept, "path", "left_anti").orderBy("cluster", "rank").collect()]
        return out + ([{"path": None, "members": loose, "existing": False, "description": "ungrouped"}] if loose else [])

    def accept(self, proposals: list[dict]) -> None:
        """Adds new categories and three central members of each as examples."""
        for p in proposals:
            if p["path"] is None:
                continue
            if p["path"] not in self.cfg.paths:
                if self.config_path:
                    C.add_categories(self.config_path, [C.Category(p["path"], p["description"])])
                self.cfg.categories.append(C.Category(p["path"], p["description"]))
            for member in p["members"][:3]:
                self.teach(member, p["path"])

    def doctor(self) -> DataFrame:
        """check, ok and detail of what a run depends on."""
        where = locality(self.cfg.model.url)
        checks = [("offline", where != "remote" or self.cfg.model.allow_remote, f"{self.cfg.model.url} is {where}")]
        for need in [self.cfg.model.name] * (self.cfg.strategy.mode != "embed") + [self.cfg.strategy.embed_model] * (self.cfg.strategy.mode != "llm"):
            try:
                checks.append((f"model {need}", M.has_model(self.backend, need), ""))
            except M.BackendError as e:
                checks.append((f"model {need}", False, str(e)))
        checks.append(("pdf", bool(extract.pdf_support()), extract.pdf_support() or "PDFs count as scans"))
        checks.append(("questions", True, f"{self.queue().count()} pending"))
        return self.spark.createDataFrame([(a, bool(b), c) for a, b, c in checks], "check string, ok boolean, detail string")
