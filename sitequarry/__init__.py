"""sitequarry: web-site audits over already collected pages, links and logs, as Spark jobs."""
