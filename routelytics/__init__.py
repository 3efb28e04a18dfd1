"""Routelytics: rule-driven message routing and routing analytics on Spark."""
