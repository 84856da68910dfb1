"""rosterloom: reconcile an authoritative roster with a knowledge graph, as Spark plans."""
