"""Jobs for building and auditing labeled image and content classification data on Spark."""
