"""The organism registry: hosts, their id prefixes and microbiomes, from YAML."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Microbiome:
    id: str
    display_name: str
    data_dir: str = ""
    source_url: str = ""


@dataclass(frozen=True)
class Host:
    id: str
    display_name: str
    latin_binomial: str
    ncbi_tax_id: int
    default: bool = False
    transcript_id_prefixes: tuple[str, ...] = ()
    genome_dir: str = ""
    genome_file_regex: str = ""
    transcript_chunks_dir: str = ""
    reference_url: str = ""
    microbiomes: tuple[Microbiome, ...] = field(default=())

    @property
    def has_genome(self) -> bool:
        return bool(self.genome_dir and self.genome_file_regex)


class Registry:
    def __init__(self, hosts: list[Host]):
        self.hosts = {h.id: h for h in hosts}
        self.microbiomes = {m.id: (m, h) for h in hosts for m in h.microbiomes}
        if len(self.hosts) != len(hosts) or len(self.microbiomes) != sum(len(h.microbiomes) for h in hosts):
            raise ValueError("ids of hosts and microbiomes must be unique")

    @classmethod
    def load(cls, path: str) -> Registry:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.build(yaml.safe_load(f))

    @classmethod
    def build(cls, data: dict) -> Registry:
        hosts = []
        for h in data["hosts"]:
            known = {k: v for k, v in h.items() if k in Host.__dataclass_fields__}
            known |= {"ncbi_tax_id": int(h["ncbi_tax_id"]), "transcript_id_prefixes": tuple(h.get("transcript_id_prefixes") or ()), "microbiomes": tuple(Microbiome(**m) for m in h.get("microbiomes") or ())}
            hosts.append(Host(**known))
        return cls(hosts)

    def by_binomial(self, name: str) -> Host | None:
        return next((h for h in self.hosts.values() if h.latin_binomial.lower() == name.strip().lower()), None)

    def by_tax_id(self, tax_id: int | str) -> Host | None:
        try:
            return next((h for h in self.hosts.values() if h.ncbi_tax_id == int(tax_id)), None)
        except ValueError:
            return None

    def by_transcript(self, transcript: str) -> Host | None:
        """The host with the longest prefix of an id."""
        fits = [(len(p), h) for h in self.hosts.values() for p in h.transcript_id_prefixes if transcript.startswith(p)]
        return max(fits, key=lambda x: x[0])[1] if fits else None

    def host_of(self, microbiome: str) -> Host | None:
        return self.microbiomes[microbiome][1] if microbiome in self.microbiomes else None

    def is_host(self, species: str) -> bool:
        return species in self.hosts

    def is_microbiome(self, species: str) -> bool:
        return species in self.microbiomes

    def default_host(self) -> Host | None:
        return next((h for h in self.hosts.values() if h.default), next(iter(self.hosts.values()), None))

    def prefixes(self, spark: SparkSession) -> DataFrame:
        rows = [(p, h.id) for h in self.hosts.values() for p in h.transcript_id_prefixes]
        return spark.createDataFrame(rows, "prefix string, host string")

    def to_dict(self) -> dict:
        return {"hosts": [asdict(h) for h in self.hosts.values()]}
