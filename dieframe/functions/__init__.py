"""Column functions: scalar rules, the condition language and the formula compiler."""
