"""sparkloom: knowledge-base analytics and question answering as Spark plans."""
