"""basaltiq.functions"""
